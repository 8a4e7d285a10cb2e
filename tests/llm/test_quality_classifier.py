import numpy as np
from pyspark.sql import functions as F

from scanweft.llm import quality_classifier as qc

DIR = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    """Trained on a sample of labelled documents, judged on all others."""
    docs, labels = (spark.read.parquet(f"{DIR}/{t}.parquet") for t in ("documents", "labels"))
    sample = 600
    trained = {r.doc_id for r in labels.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()}
    rows = qc.judged(docs, labels, F.col("source"), F.col("lang"), sample=sample).join(labels, "doc_id").collect()
    rows = [r for r in rows if r.doc_id not in trained]
    right = {q: np.mean([r.kept == bool(q) for r in rows if r.quality == q]) for q in (0, 1)}
    assert right[1] > 0.99 and right[0] > 0.95


def plain(rows):
    """The posterior of rows (host, path, evidence), by loops."""
    p = np.array([1 / (1 + np.exp(-e)) for *_, e in rows])
    mean = np.clip(p.mean(), 0.01, 0.99)

    def groups(key):
        out = {}
        for i, r in enumerate(rows):
            out.setdefault(key(r), []).append(i)
        return out

    def strength(of, prior):
        total = len(rows)
        between = sum(len(i) * (p[i].mean() - prior(k)) ** 2 - prior(k) * (1 - prior(k)) for k, i in of.items()) / total
        return max(2.0, min(1000.0, max(prior(k) * (1 - prior(k)) for k in of) / max(between, 1e-6) - 1))

    hosts, paths = groups(lambda r: r[0]), groups(lambda r: (r[0], r[1]))
    hs = strength(hosts, lambda _: mean)
    shrunk = {h: (p[i].sum() + hs * mean) / (len(i) + hs) for h, i in hosts.items()}
    ps = strength(paths, lambda k: shrunk[k[0]])
    out = []
    for i, (h, q, e) in enumerate(rows):
        host = (p[hosts[h]].sum() - p[i] + hs * mean) / (len(hosts[h]) - 1 + hs)
        path = (p[paths[h, q]].sum() - p[i] + ps * host) / (len(paths[h, q]) - 1 + ps)
        path = np.clip(path, 0.01, 0.99)
        out.append(1 / (1 + np.exp(-(e + np.log(path / (1 - path)) - np.log(mean / (1 - mean))))))
    return out


def test_shrinkage_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = []
    for h in ["good", "bad", None, "tiny"]:
        for _ in range({"tiny": 2}.get(h, 150)):
            rows.append((h, str(rng.choice(["a", "b"])) if h != "bad" else None, float(rng.normal({"good": 2, "bad": -2}.get(h, 0.5)))))
    table = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"id long, __host string, __path string, {qc.EVIDENCE} double").repartition(3)
    for limit in (qc.BROADCAST_ROWS, -1):
        monkeypatch.setattr(qc, "BROADCAST_ROWS", limit)
        got = [r["__posterior"] for r in qc.with_posterior(table, qc.sites(table)).orderBy("id").collect()]
        assert np.allclose(got, plain(rows))
    by_host = {h: np.mean([g for g, r in zip(got, rows, strict=True) if r[0] == h and abs(r[2]) < 1]) for h in ("good", "bad")}
    assert by_host["good"] > by_host["bad"]


def test_awkward_documents(spark, docs, empty, rows):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    none = labels.where("doc_id < 0")
    for own in (labels, none):
        out = qc.judged(docs, own, F.col("source"), F.col("lang"))
        assert out.count() == len(rows) and out.where("kept is null").count() == 0
        kept = qc.filtered(docs, own, F.col("source"), F.col("lang"))
        assert kept.columns == docs.columns and kept.count() == out.where("kept").count()
        assert qc.judged(empty, own, F.col("source"), F.col("lang")).count() == 0
    assert qc.filtered(docs, none, F.col("source"), F.col("lang")).count() == len(rows)


def test_hosts_and_paths_of_urls(spark):
    urls = {"https://www.Example.org:8080/a/b/c.html?x=/y#/z": ("example.org", "/a/"), "http://u:p@h.example/": ("h.example", "/"), "ftp://h.example": ("h.example", "/"), "http://h.example?q=/a/b/": ("h.example", "/"), "http://[::1]:80/x/y": ("[::1]", "/x/"), "no url": (None, None), "": (None, None), None: (None, None)}
    rows = spark.createDataFrame([(u,) for u in urls], "url string")
    got = {r[0]: (r[1], r[2]) for r in rows.select("url", qc.host_of(rows.url), qc.path_of(rows.url)).collect()}
    assert got == urls
    deep = spark.createDataFrame([("http://h.example/a/b/c/d",)], "url string")
    assert deep.select(qc.path_of(deep.url, 2)).first()[0] == "/a/b/"


def test_columns_of_any_name_stay(spark):
    table = spark.createDataFrame([(i, "Some plain words here.", "src", "en", "MINE", 0.5, "dot") for i in range(5)], "doc_id long, text string, source string, lang string, __host string, __posterior double, `a.b` string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    out = qc.filtered(table, labels, F.col("source"), F.col("lang"))
    assert out.columns == table.columns and sorted(map(tuple, out.collect())) == sorted(map(tuple, table.collect()))
