import numpy as np

from scanweft.llm import embedding_dedup as ed


def brute(vectors):
    """Per row: links and component, by all pairs in double precision."""
    n = len(vectors)
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v) for v in vectors]
    links = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and len(vectors[i]) == len(vectors[j]):
                x, y = np.array(vectors[i], float), np.array(vectors[j], float)
                links[i, j] = links[j, i] = x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.9
    component = np.arange(n)
    while True:
        new = np.array([min(component[i], *component[links[i]]) if links[i].any() else component[i] for i in range(n)])
        if (new == component).all():
            return links, component
        component = new


def made(seed, n, dim, monkey=None):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, dim))
    for i in range(0, n, 3):
        base[i] = base[(i * 7) % (i + 1)] + rng.standard_normal(dim) * rng.choice([0.05, 0.3, 0.45])
    return [list(map(float, v.astype(np.float32))) for v in base]


def run(spark, vectors, schema="vec_id long, embedding array<float>, label int"):
    table = spark.createDataFrame([(i, v, 1) for i, v in enumerate(vectors)], schema).repartition(3)
    return {r.vec_id: r for r in ed.near_duplicates(table).collect()}


def test_one_block_is_exact_up_to_the_count(spark):
    vectors = made(1, 200, 24)
    vectors += [vectors[0]] * 5 + [[2 * x for x in vectors[3]], None, [], [0.0] * 24, [float("nan")] * 24, [float("inf")] + [1.0] * 23, [None] + [1.0] * 23, [1.0, 2.0], [2.0, 4.0]]
    links, component = brute(vectors)
    got = run(spark, vectors)
    assert len(got) == len(vectors)
    n = np.array([got[i].n_links for i in range(len(vectors))])
    assert (n <= links.sum(axis=1)).all() and n.sum() >= 0.97 * links.sum()
    assert sum(got[i].component_id == component[i] for i in got) >= 0.97 * len(got)
    assert all(got[i].kept == (got[i].component_id == i) for i in got)
    for i in range(206, 212):
        assert (got[i].n_links, got[i].component_id) == (0, i)
    assert got[212].n_links == 1 and got[213].component_id == 212


def test_many_blocks_and_parts_reach_the_recall(spark, monkeypatch):
    vectors = made(2, 900, 32)
    links, _ = brute(vectors)
    for block, part in ((100, 1024), (100, 40)):
        monkeypatch.setattr(ed, "BLOCK_ROWS", block)
        monkeypatch.setattr(ed, "PART", part)
        got = run(spark, vectors)
        n = np.array([got[i].n_links for i in range(len(vectors))])
        assert (n <= links.sum(axis=1)).all() and n.sum() >= 0.93 * links.sum()


def test_corpus_recall(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = table.where("embedding is not null").collect()
    x = np.array([r.embedding for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = (x @ x.T >= 0.9).sum(axis=1) - 1
    got = {r.vec_id: r.n_links for r in ed.near_duplicates(table).collect()}
    n = np.array([got[r.vec_id] for r in rows])
    assert (n <= want).all() and n.sum() >= 0.98 * want.sum()


def test_empty_and_null_ids(spark):
    schema = "vec_id long, embedding array<double>"
    assert ed.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    got = ed.near_duplicates(spark.createDataFrame([(None, [1.0, 0.0]), (5, [1.0, 0.0]), (9, [1e200, 0.0]), (7, [1e-200, 0.0])], schema)).collect()
    assert sorted((str(r.vec_id), r.n_links, r.component_id) for r in got) == [("5", 2, 5), ("7", 2, 5), ("9", 2, 5), ("None", 0, None)]


def close_together(seed, n, dim):
    """Vectors of a mean cosine of 0.7, every third with a twin at a cosine of about 0.92."""
    rng = np.random.default_rng(seed)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    x = unit(np.sqrt(0.7) * unit(np.ones(dim)) + np.sqrt(0.3) * unit(rng.standard_normal((n, dim))))
    away = rng.standard_normal((n, dim))
    away = unit(away - (away * x).sum(axis=1, keepdims=True) * x)
    x[2::3] = (0.92 * x + np.sqrt(1 - 0.92**2) * away)[1::3][: len(x[2::3])]
    return x


def test_too_few_rounds_give_larger_blocks(monkeypatch):
    monkeypatch.setattr(ed, "MOST_ROUNDS", 20)
    x = close_together(1, 2000, 32)
    wide, small = ed.calibrated(x, 10**8, 0.9, 0.98, 11), ed.calibrated(x, 1000, 0.9, 0.98, 11)
    assert small.bits == 1 and wide.bits < 18 and wide.rounds <= 20
    rng = np.random.default_rng(2)
    away = rng.standard_normal(x.shape)
    away -= (away * x).sum(axis=1, keepdims=True) * x
    twins = 0.9 * x + np.sqrt(1 - 0.81) * away / np.linalg.norm(away, axis=1, keepdims=True)
    for plan in (wide, small):
        assert (plan.keys(plan.signs(x)) == plan.keys(plan.signs(twins))).any(axis=1).mean() >= 0.97


def test_recall_of_close_vectors_and_of_every_length(spark, monkeypatch):
    monkeypatch.setattr(ed, "MOST_ROUNDS", 6)
    monkeypatch.setattr(ed, "BLOCK_ROWS", 40)
    vectors = [v.tolist() for dim, n in ((24, 500), (16, 300), (8, 30)) for v in close_together(dim, n, dim)]
    links, _ = brute(vectors)
    got = run(spark, vectors, "vec_id long, embedding array<double>, label int")
    n = np.array([got[i].n_links for i in range(len(vectors))])
    assert (n <= links.sum(axis=1)).all() and n.sum() >= 0.97 * links.sum()
    assert n[500:800].sum() >= 0.97 * links.sum(axis=1)[500:800].sum()
