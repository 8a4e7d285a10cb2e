import random
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from scanweft.llm import jaccard_join as jj
from scanweft.llm.components import components, forest

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, rule):
    sets = []
    for _, text in rows:
        words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(words[i : i + rule.k]) for i in range(len(words) - rule.k + 1)} or ({tuple(words)} if words else set()))
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    by_id = {}
    for i, (d, _) in enumerate(rows):
        by_id.setdefault(d if d is not None else ("null", i), []).append(i)
    for same in by_id.values():
        for i in same[1:]:
            parent[root(same[0])] = root(i)
    for i, j in combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and rule.den * both >= rule.num * len(sets[i] | sets[j]):
            parent[root(i)] = root(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(root(i), []).append(d)
    least = {r: min((d for d in ds if d is not None), default=None) for r, ds in groups.items()}
    return sorted(((d, len(sets[i]), least[root(i)]) for i, (d, _) in enumerate(rows)), key=str)


def got(spark, rows, rule):
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return sorted(map(tuple, jj.joined(table, rule).rows.collect()), key=str)


def near_copies(seed, n, edits):
    """Groups of copies with edits around the threshold, chains, and a passage that all share."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    common = " ".join(rng.choice(vocabulary) for _ in range(12))
    out = []
    while len(out) < n:
        words = [rng.choice(vocabulary) for _ in range(rng.randint(1, 160))]
        for _ in range(rng.randint(1, 7)):
            words = list(words)
            for _ in range(rng.randint(0, edits)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            text = " ".join(words) + (" " + common if rng.random() < 0.5 else "")
            out.append(text.upper() if rng.random() < 0.2 else text)
    ids = rng.sample(range(10 * n), n)
    return list(zip(ids, out, strict=False))


@pytest.mark.parametrize(("seed", "rule"), [(1, jj.Rule()), (2, jj.Rule(5, 80, 100))])
def test_equals_brute_force(spark, seed, rule, monkeypatch):
    monkeypatch.setattr(jj, "PART", 3)
    rows = near_copies(seed, 120, 4)
    assert got(spark, rows, rule) == brute(rows, rule)


def test_awkward_documents(spark, docs, rows):
    have = [(r[0], r[1]) for r in rows]
    assert sorted(map(tuple, jj.joined(docs).rows.collect()), key=str) == brute(have, jj.Rule())


def test_threshold_is_exact(spark):
    base = [f"a{i}" for i in range(103)]  # 100 shingles
    rows = [(i, " ".join(base[: 88 + i])) for i in range(16)]
    assert got(spark, rows, jj.Rule()) == brute(rows, jj.Rule())


def test_empty(empty):
    assert jj.joined(empty).rows.count() == 0 and jj.deduplicated(empty).count() == 0


def test_deduplicated(docs, rows):
    out = jj.deduplicated(docs)
    assert out.columns == docs.columns
    want = {d for d, _, c in brute([(r[0], r[1]) for r in rows], jj.Rule()) if d is not None and d == c}
    ids = [r.doc_id for r in out.collect()]
    assert len(ids) == len(set(ids)) and {i for i in ids if i is not None} == want and (None in ids)


def test_signatures_bound_the_overlap():
    rng = np.random.default_rng(3)
    for _ in range(50):
        a = rng.integers(0, 2**63, rng.integers(1, 3000), dtype=np.uint64)
        b = np.concatenate([a[: rng.integers(0, len(a) + 1)], rng.integers(0, 2**63, rng.integers(1, 2000), dtype=np.uint64)])
        sets = jj.Sets(np.repeat([0, 1], [len(a), len(b)]), np.concatenate([a, b]), np.array([len(a), len(b)]))
        small, wide = jj.signatures(sets)
        for bits in (small, wide):
            x = jj.folded(bits, min(map(len, bits)))
            assert jj._overlap_bound(len(a), len(b), x[:1], x[1:])[0] >= len(np.intersect1d(a, b))
        assert (jj.folded(wide, jj.BITS // 8) == jj.folded(small, jj.BITS // 8)).all()


def test_components(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(0, 60)] + [(rng.randrange(100, 400), rng.randrange(100, 400)) for _ in range(150)] + [(7, 7), (1000, 2000), (2000, 1000)]
    node, root = forest(np.array([a for a, _ in links]), np.array([b for _, b in links]))
    want = dict(zip(node.tolist(), root.tolist(), strict=True))
    table = spark.createDataFrame(links, "a long, b long").repartition(7)
    assert {r.node: r.component for r in components(table).collect()} == want
    assert components(table.where("a < 0")).count() == 0


def batches_of(rows, names, rng):
    at = 0
    while at < len(rows):
        to = min(len(rows), at + rng.choice([1, 1, 2, 3, 9, 40]))
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows[at:to]], pa.int64()) for c in range(len(names))], names=names)
        at = to


def test_streams_of_groups_however_batches_are_cut():
    rng = random.Random(8)
    for _ in range(200):
        rows = sorted((rng.randrange(12), rng.randrange(100)) for _ in range(rng.randint(0, 60)))
        by, whole = {}, {}
        for k, d in rows:
            by.setdefault(k, []).append(d)
        for table in jj._whole_groups(batches_of(rows, ["key", "x"], rng), ["key"]):
            keys = table.column("key").to_pylist()
            assert not set(keys) & set(whole)
            for k, x in zip(keys, table.column("x").to_pylist(), strict=True):
                whole.setdefault(k, []).append(x)
        assert whole == by


def test_shingles_met_again(spark):
    rng = random.Random(9)
    rows = [(rng.randrange(30), d) for d in range(60)]
    by = {}
    for k, d in rows:
        by.setdefault(k, []).append(d)
    got = sorted(map(tuple, jj._met_again(spark.createDataFrame(rows, "shingle long, doc_id long")).collect()))
    assert got == sorted((k, d, min(v), len(v)) for k, v in by.items() if len(v) > 1 for d in v)


def test_a_large_component_meets_only_others(spark, monkeypatch):
    """One group of near copies fills a shingle's tiles; a few other sets share its shingles without a star to them."""
    monkeypatch.setattr(jj, "PART", 4)
    laid = []
    real = jj._compared
    monkeypatch.setattr(jj, "_compared", lambda rows, key, rule: laid.append((key, rows)) or real(rows, key, rule))
    rng = random.Random(6)
    words = [f"a{i}" for i in range(120)]
    rows = []
    for i in range(60):
        w = list(words)
        w[rng.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(w)))
    for i in range(6):  # these share many shingles with all, some of them enough
        w = list(words)
        for j in rng.sample(range(120), 2 + i):
            w[j] = f"y{i}.{j}"
        rows.append((100 + i, " ".join(w)))
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(map(tuple, jj.joined(table).rows.collect()), key=str) == brute(rows, jj.Rule())
    tiles = [df for key, df in laid if len(key) == 3]
    assert tiles
    for df in tiles:  # copies of rows stay in proportion to them
        assert df.count() < 40 * 66 * 60 / 4


def test_columns_of_any_name_stay(spark):
    w = " ".join(f"a{i}" for i in range(40))
    rows = [(1, w, "x", 2, 3), (2, w, "y", 4, 5), (3, "other words", "z", 6, 7)]
    table = spark.createDataFrame(rows, "doc_id long, text string, `a.b` string, gone int, __twice int")
    out = jj.deduplicated(table)
    assert out.columns == table.columns and sorted(map(tuple, out.collect())) == [rows[0], rows[2]]


def test_a_null_id_in_front_hides_no_set(spark):
    words = [f"a{i}" for i in range(100)]
    rows = [(None, " ".join(words)), (5, " ".join(words)), (9, " ".join([*words[:99], "other"]))]
    table = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)  # one task, in this order
    out = sorted(map(tuple, jj.joined(table).rows.collect()), key=str)
    assert out == brute(rows, jj.Rule()) and {c for *_, c in out} == {5}
    assert sorted(r.doc_id or 0 for r in jj.deduplicated(table).collect()) == [0, 5]
