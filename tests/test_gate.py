"""The scan gate: a worked case, invariants, and batch against stream."""

import random
import shutil

from pyspark.sql import functions as F

from scanweft.operators import gate, history
from scanweft.sources import catalog
from scanweft.streaming import gate as stream

TIMES = [0, 1000, 1500, 2000, 4999, 5000, 6000, 7500, 8000, 8100, 8200, 8300, 9799]
READS = "AABAAAXXXYAYY"
EMIT = [1, 0, 1, 1, 0, 1, 0, 0, 1, 0, 1, 0, 1]


def worked(device):
    return [(device, i, t, c, c in "AB") for i, (t, c) in enumerate(zip(TIMES, READS, strict=True))]


def made(seed, n=600):
    rng = random.Random(seed)
    rows, at = [], {d: 0 for d in range(4)}
    for i in range(n):
        d = rng.choice([0, 0, 0, 1, 2, 3])
        at[d] += rng.choice([0, 10, 300, 900, 1499, 1500, 2999, 3000, 9000])
        c = rng.choice("AABXY")
        rows.append((d, i, at[d], c, c in "AB"))
    return rows


def plain(rows):
    """The rules, one read after the other."""
    out, held = [], {}
    for d, s, t, c, known in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        last, last_at, pend, pend_at = held.get(d, ("", 0, "", 0))
        if c == last and t - last_at < 3000:
            continue
        if not known and not (c == pend and t - pend_at < 1500):
            held[d] = (last, last_at, c, t)
            continue
        held[d] = (c, t, "", pend_at)
        out.append((d, s))
    return sorted(out)


def test_worked_case(spark):
    got = gate.accepted(spark.createDataFrame(worked(1) + worked(2), catalog.SCANS).repartition(4)).collect()
    assert sorted((r.device_id, r.seq) for r in got) == [(d, i) for d in (1, 2) for i, e in enumerate(EMIT) if e]


def test_random_reads(spark):
    for seed in range(3):
        rows = made(seed)
        got = gate.accepted(spark.createDataFrame(rows, catalog.SCANS).repartition(5)).collect()
        assert sorted((r.device_id, r.seq) for r in got) == plain(rows)
        by = {}
        for r in sorted(got, key=lambda r: (r.device_id, r.t_ms, r.seq)):
            code, t = by.get(r.device_id, (None, 0))
            assert code != r.code or r.t_ms - t >= gate.COOLDOWN_MS
            by[r.device_id] = (r.code, r.t_ms)


def test_stretches_across_spans_and_long_ones(spark, monkeypatch):
    monkeypatch.setattr(gate, "SPAN_MS", 2000)
    for seed, folded in ((3, 1000), (4, 5), (5, 0)):
        monkeypatch.setattr(gate, "FOLDED", folded)
        rows = made(seed, 300)
        got = gate.accepted(spark.createDataFrame(rows, catalog.SCANS).repartition(5)).collect()
        assert sorted((r.device_id, r.seq) for r in got) == plain(rows)


def test_empty_and_null_codes(spark):
    assert gate.accepted(spark.createDataFrame([], catalog.SCANS)).count() == 0
    rows = [(1, 0, 0, None, None), (1, 1, 10, None, None), (None, 2, 0, "A", True)]
    assert gate.accepted(spark.createDataFrame(rows, catalog.SCANS)).count() >= 1


def run_stream(spark, tmp_path, batches, name):
    source, out = tmp_path / f"{name}-in", tmp_path / f"{name}-out"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, catalog.SCANS).coalesce(1).write.parquet(f"file://{tmp_path}/{name}-part{i}")
        source.mkdir(exist_ok=True)
        for f in (tmp_path / f"{name}-part{i}").glob("*.parquet"):
            shutil.move(f, source / f"{i:03d}.parquet")
        reads = spark.readStream.schema(catalog.SCANS).option("maxFilesPerTrigger", 1).parquet(f"file://{source}")
        q = stream.accepted(reads).writeStream.format("parquet").option("path", f"file://{out}").option("checkpointLocation", f"file://{tmp_path}/{name}-check").trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.parquet(f"file://{out}").collect()


def test_stream_equals_batch_however_it_is_cut(spark, tmp_path):
    rows = sorted(made(9, 240), key=lambda r: r[2])
    for cuts in ([240], [60, 100, 170, 240]):
        batches = [rows[a:b] for a, b in zip([0, *cuts], cuts, strict=False)]
        got = run_stream(spark, tmp_path, batches, f"s{len(cuts)}")
        assert sorted((r.device_id, r.seq) for r in got) == plain(rows)


def test_stream_drops_and_counts_late_reads(spark, tmp_path):
    got = run_stream(spark, tmp_path, [[(1, 0, 5000, "A", True)], [(1, 1, 100, "B", True), (1, 2, 9000, "B", True)]], "late")
    assert sorted((r.seq, r.late) for r in got) == [(0, 0), (2, 1)]


def test_stream_history_stays_bounded(spark, tmp_path):
    path = f"file://{tmp_path}/history"
    source = tmp_path / "entries"
    source.mkdir()
    for i in range(3):
        rows = [(d, 100 * i + s, "c", "miss", None, 1000 * i + s) for d in (1, 2) for s in range(40)]
        spark.createDataFrame(rows, catalog.HISTORY).coalesce(1).write.parquet(f"file://{tmp_path}/e{i}")
        for f in (tmp_path / f"e{i}").glob("*.parquet"):
            shutil.move(f, source / f"{i}.parquet")
        entries = spark.readStream.schema(catalog.HISTORY).parquet(f"file://{source}")
        stream.keep_history(entries, path, f"file://{tmp_path}/hcheck").trigger(availableNow=True).start().awaitTermination()
        kept = stream.latest_history(spark, path)
        assert kept.groupBy("device_id").count().where(F.col("count") != min(60, 40 * (i + 1))).count() == 0
    newest = {r.seq for r in kept.where("device_id = 1").collect()}
    assert newest == {200 + s for s in range(40)} | {100 + s for s in range(20, 40)}
    assert history.recent(kept).count() == 120
