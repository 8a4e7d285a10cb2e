import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from scanweft.llm import substring_dedup as sd
from scanweft.llm.fm_index import Bits, FMIndex

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window):
    words = [WORD.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (d, _), w in zip(rows, words, strict=True):
        gone = {j for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        out.append((d, len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest()))
    return sorted(out, key=str)


def got(spark, rows, window, gram):
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return sorted(map(tuple, sd.digest(table, window, gram).collect()), key=str)


def corpus(seed, n, vocabulary):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)]
    passage = [rng.choice(words) for _ in range(60)]
    rows = []
    for i in range(n):
        w = [rng.choice(words) for _ in range(rng.randint(0, 150))]
        if rng.random() < 0.5:
            at = rng.randint(0, len(w))
            a = rng.randint(0, 20)
            w[at:at] = passage[a : rng.randint(a, 60)]
        if rng.random() < 0.2 and rows:
            w = (rows[-1][1] or "").split()
            if w:
                w[rng.randrange(len(w))] = "edit"
        if rng.random() < 0.1:
            w = w + w
        rows.append((i, rng.choice([" ", "\n", " \t "]).join(w)))
    return rows


@pytest.mark.parametrize(("window", "gram", "vocabulary", "hot"), [(35, 8, 300, 5000), (35, 8, 300, 2), (12, 4, 3, 5000), (12, 4, 3, 3)])
def test_equals_brute_force(spark, window, gram, vocabulary, hot, monkeypatch):
    monkeypatch.setattr(sd, "HOT", hot)
    rows = corpus(window + vocabulary + hot, 80, vocabulary)
    assert got(spark, rows, window, gram) == brute(rows, window)


def test_long_stretches_are_cut_alike(spark, monkeypatch):
    monkeypatch.setattr(sd, "STRETCH", 64)
    rows = corpus(9, 40, 50)
    assert got(spark, rows, 12, 4) == brute(rows, 12)


def test_awkward_documents(docs, rows):
    have = [(r[0], r[1]) for r in rows]
    assert sorted(map(tuple, sd.digest(docs).collect()), key=str) == brute(have, 35)


def test_same_id_other_text(spark):
    w = [f"a{i}" for i in range(50)]
    rows = [(1, " ".join(w)), (1, " ".join(["x"] * 20 + w[:40])), (2, " ".join(w[:36]))]
    assert got(spark, rows, 35, 8) == brute(rows, 35)


def test_empty(empty):
    assert sd.digest(empty).count() == 0 and sd.deduplicated(empty).count() == 0


def test_deduplicated_keeps_untouched_texts(spark):
    w = [f"a{i}" for i in range(40)]
    rows = [(1, "keep  me \n as I am", 7), (2, "\n".join(w[:20]) + " " + " ".join(w[20:]), 7), (3, "new\nline " + " ".join(w) + " tail\nend", 7), (None, None, None)]
    out = sd.deduplicated(spark.createDataFrame(rows, "doc_id long, text string, id long"))
    assert out.columns == ["doc_id", "text", "id"]
    assert sorted(map(tuple, out.collect()), key=str) == [(1, rows[0][1], 7), (2, "", 7), (3, "new\nline tail\nend", 7), (None, None, None)]


def test_index_counts():
    rng = np.random.default_rng(1)
    for window, symbols in ((5, 3), (8, 2), (35, 4), (4, 5), (2, 3), (9, 2), (1, 4)):
        sequences = [rng.integers(0, symbols, n).astype(np.uint64) * np.uint64(977) for n in rng.integers(0, 60, 30)]
        sequences += sequences[:5]
        times = rng.integers(1, 4, len(sequences))
        index = FMIndex(np.concatenate(sequences), np.array([len(s) for s in sequences]), times, window)
        seen = Counter()
        for s, t in zip(sequences, times.tolist(), strict=True):
            for i in range(len(s) - window + 1):
                seen[tuple(s[i : i + window].tolist())] += t
        flat, slots = index.window_counts()
        for s, at in zip(sequences, slots.tolist(), strict=True):
            n = max(0, len(s) - window + 1)
            assert flat[at : at + n].tolist() == [seen[tuple(s[i : i + window].tolist())] for i in range(n)]
        for pattern, n in list(seen.items())[:5]:
            assert index.count(np.array(pattern, np.uint64)) == n
        assert index.count(np.array([5], np.uint64)) == 0


def test_bit_vectors_are_small_and_exact():
    rng = np.random.default_rng(2)
    for n in (0, 1, 63, 64, 511, 512, 513, 5000):
        for bit in (rng.random(n) < 0.5, np.repeat(rng.random(-(-n // 300)) < 0.5, 300)[:n], np.zeros(n, bool), np.ones(n, bool)):
            at = np.arange(n + 1)
            held = Bits(bit)
            assert held.rank(at).tolist() == np.concatenate([[0], np.cumsum(bit)]).tolist() and held.total == bit.sum()
    runs = np.repeat(rng.random(200) < 0.5, 3000)
    assert Bits(runs).bytes() < 0.75 * len(runs) / 8


def test_rows_alike_are_worked_on_once(spark, monkeypatch):
    rng = random.Random(5)
    w = [f"a{rng.randrange(10_000)}" for _ in range(90)]
    rows = [(7, " ".join(w))] * 2000 + [(None, " ".join(w[20:80] + ["end"]))] * 300 + [(None, f"short {i}") for i in range(50)] + [(8, " ".join(w[:34]))]
    seen = []
    real = sd.stored
    monkeypatch.setattr(sd, "stored", lambda df, name, **o: seen.append((name, real(df, name, **o))) or seen[-1][1])
    assert got(spark, rows, 35, 8) == brute(rows, 35)
    sizes = {name: df.count() for name, df in seen}
    assert sizes["repeats"] == 2 and sizes["reported"] < 40 and sizes["live-segments"] < 400


def test_null_ids_whose_marks_are_equal(spark, monkeypatch):
    """Only one of the two hashes tells the texts apart."""
    real = sd._named
    monkeypatch.setattr(sd, "_named", lambda *a: [real(*a)[0], sd.F.lit(5).cast("long").alias("k1"), *real(*a)[2:]])
    w = [f"a{i}" for i in range(60)]
    rows = [(None, " ".join(w)), (None, " ".join(w[5:50])), (None, "short 1"), (None, "short 2"), (3, " ".join(w[:36]))]
    assert got(spark, rows, 35, 8) == brute(rows, 35)


def test_odd_columns_stay(spark):
    w = " ".join(f"a{i}" for i in range(40))
    rows = [(1, w, "x", 2, 3, "own"), (2, "new " + w, "y", 4, 5, "mine")]
    table = spark.createDataFrame(rows, "doc_id long, text string, `a.b` string, places int, own_id int, __places string")
    out = sd.deduplicated(table)
    assert out.columns == table.columns
    assert sorted(map(tuple, out.collect())) == [(1, "", "x", 2, 3, "own"), (2, "new", "y", 4, 5, "mine")]
