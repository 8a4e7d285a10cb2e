import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def make(seed: int, n: int = 60) -> list[tuple]:
    """Documents with every awkward case: nulls, empty, white space, very long, repeats, ties, odd characters."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé珍😀") for _ in range(rng.randint(1, 7))) for _ in range(40)]
    rows = []
    for i in range(n):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(0, 120)))
        if i % 3 == 0:
            text = text.replace(" ", rng.choice(["\n", "  ", "\t", " ", "　", " \n", "\r\n"]), rng.randint(1, 9))
        rows.append((i, text, "en", f"src{i % 4}", len(text)))
    rows += [(100, None, None, None, None), (101, "", "en", "src0", 0), (102, " \t\n\x0b\x0c\r ", "en", "src0", 7), (103, "x" * 5000, "en", "src1", 5000), (104, " ".join(words * 120), "en", "src1", 1), (None, "no id here at all", "en", "src2", 17)]
    rows += [(105, rows[5][1], "en", "src3", 1), (105, rows[5][1], "en", "src3", 1), (106, rows[5][1], "de", "src3", 1), (107, rows[4][1] + " tail", "en", "src0", 1)]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def rows():
    return make(3)


@pytest.fixture(scope="session")
def docs(spark, rows):
    """With further columns whose names clash with those of the operators."""
    return spark.createDataFrame([(*r, "other", 5, 7) for r in rows], SCHEMA + ", shard string, part int, ids int").repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
