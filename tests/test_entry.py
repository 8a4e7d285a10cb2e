"""The driver's contract holds with and without the optional parts."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry(spark):
    import __spark_entry__ as e

    out = e.entry(spark)
    assert out.columns == ["k", "form", "code", "status", "ok", "item_id", "item_name"] and out.count() == 1400
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_without_the_optional_parts(tmp_path):
    for name in ("scanweft", "__spark_entry__.py"):
        (shutil.copytree if os.path.isdir(f"{ROOT}/{name}") else shutil.copy)(f"{ROOT}/{name}", tmp_path / name)
    shutil.rmtree(tmp_path / "scanweft/llm", ignore_errors=True)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert e.queries().keys() == e.oracle_sql().keys(); print(len(e.queries()))"], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr
    assert int(said.stdout) >= 20


def test_entry_without_what_the_optional_parts_need(tmp_path):
    (tmp_path / "public_tokenizers.py").write_text("raise ModuleNotFoundError('public_tokenizers')")
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert e.queries().keys() == e.oracle_sql().keys(); print(len(e.queries()))"], cwd=tmp_path, env=os.environ | {"PYTHONPATH": f"{tmp_path}{os.pathsep}{ROOT}"}, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr
    assert int(said.stdout) >= 20
