import zlib
from collections import Counter, defaultdict

import numpy as np

from scanweft.llm import sharding


def check(rows, out, shards):
    assert Counter((r.doc_id, r.text) for r in out) == Counter((r[0], r[1]) for r in rows)
    slots = defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, shards) and 0 <= r.shard < shards
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({(r.doc_id, r.shard, r.grown_shard) for r in out}) == len({r.doc_id for r in out})


def test_shards(docs, rows):
    out = sharding.shard(docs, 40).collect()
    check(rows, out, 40)
    again = {(r.doc_id, r.text, r.shard): r.slot for r in sharding.shard(docs.repartition(5), 40).collect()}
    assert again.keys() == {(r.doc_id, r.text, r.shard) for r in out}


def test_many_buckets_a_shard(docs, rows):
    check(rows, sharding.shard(docs, 3, bucket_bytes=2000).collect(), 3)


def test_buckets_stay_small_whatever_repeats(spark, monkeypatch):
    """Most rows equal, and most others without an id: no bucket is twice the size asked for."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(sharding.uuid, "uuid4", lambda: type("Fixed", (), {"hex": "test-small"}))
    monkeypatch.setattr(sharding, "stored", lambda df, name: df)
    rows = [(7, "the same text again and again " * 10)] * 3000 + [(None, f"no id {i} " + "x" * 200) for i in range(2000)] + [(i, f"text {i}") for i in range(500)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    check(rows, sharding.shard(table, 4, bucket_bytes=20_000).collect(), 4)
    files = spark.read.parquet(f"{sharding.shared_dir(spark)}/shards-test-small")
    sizes = [r[0] for r in files.groupBy("shard", "sub").agg(F.sum(F.octet_length("text") + 16)).select(F.col("sum((octet_length(text) + 16))")).collect()]
    assert max(sizes) < 40_000 and len(sizes) > 60


def test_order_is_repeatable_and_shuffled(spark):
    table = spark.createDataFrame([(i, f"t{i}") for i in range(3000)], "doc_id long, text string")
    a, b = ([(r.shard, r.slot, r.doc_id) for r in sharding.shard(t, 2).collect()] for t in (table, table.repartition(7)))
    assert sorted(a) == sorted(b)
    ids = [d for s, _, d in sorted(a) if s == 0]
    assert abs(np.corrcoef(ids, np.arange(len(ids)))[0, 1]) < 0.1


def test_growth_moves_only_to_the_new_shard():
    keys = np.random.default_rng(1).integers(0, 2**63, 20000, dtype=np.uint64)
    a, b = sharding.jump_hash(keys, 40), sharding.jump_hash(keys, 41)
    assert ((a == b) | (b == 40)).all() and abs((b == 40).mean() - 1 / 41) < 0.01
    assert np.bincount(a, minlength=40).std() < 40


def test_fisher_yates_is_uniform():
    counts = Counter(tuple(sharding.fisher_yates(3, np.random.default_rng(i)).tolist()) for i in range(6000))
    assert len(counts) == 6 and max(counts.values()) < 1200


def test_empty(empty):
    assert sharding.shard(empty).count() == 0


def test_checksum_of_spark_is_zlib(spark):
    from pyspark.sql import functions as F

    assert spark.range(1).select(F.crc32(F.lit("é x"))).first()[0] == zlib.crc32("é x".encode())
