import random
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scanweft.llm import shared

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab \t\n\r\x0b\x0c\x1c é珍", max_size=30)), max_size=8))
def test_words(texts):
    raw, offsets = shared.buffer_of(pa.array(texts, pa.string()))
    starts, ends, row = shared.words_of(raw, offsets)
    got = [(r, raw[a:b].tobytes()) for a, b, r in zip(starts.tolist(), ends.tolist(), row.tolist(), strict=True)]
    assert got == [(i, w) for i, t in enumerate(texts) for w in WORD.findall((t or "").encode())]
    hashes = shared.span_hash(raw, starts, ends)
    assert len(set(zip(hashes.tolist(), strict=True))) == len({w for _, w in got})


def test_sliced_columns_and_steps():
    rng = random.Random(1)
    texts = [None if rng.random() < 0.1 else "x" * rng.randint(0, 50) for _ in range(200)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(200)), pa.array(texts)], names=["i", "text"]).slice(13, 150)
    parts = list(shared.steps(iter([batch]), limit=100))
    assert [x for p in parts for x in p.column(0).to_pylist()] == list(range(13, 163))
    assert all(sum(len(t or "") for t in p.column(1).to_pylist()) <= 100 or p.num_rows == 1 for p in parts)
    for p in parts:
        raw, offsets = shared.buffer_of(p.column(1))
        assert [raw[a:b].tobytes().decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)] == [t or "" for t in p.column(1).to_pylist()]


def test_hashes_depend_on_content_alone():
    words = np.array([5, 6, 7, 5, 6, 7, 8, 5, 6], np.uint64)
    g = shared.gram_hash(words, 3)
    assert g[0] == g[3] and len(set(g.tolist())) == 6
    raw = np.frombuffer(b"abcabxabcab" + b"y" * 10000 + b"ab" + b"y" * 10000, np.uint8)
    starts, ends = np.array([0, 3, 6, 9, 11, 10011, 10013]), np.array([3, 6, 9, 11, 10011, 10013, 20013])
    h = shared.span_hash(raw, starts, ends).tolist()
    assert h[0] == h[2] and h[3] == h[5] and h[4] == h[6] and len(set(h)) == 4


def test_words_of_a_simple_pattern_differ():
    for size in (64, 1024, 2048, 4096, 1 << 15):
        odd = np.array([i.bit_count() & 1 for i in range(size)], np.uint8)
        one, two = odd + ord("a"), ord("b") - odd
        a, b = shared.span_hash(np.concatenate([one, two]), np.array([0, size]), np.array([size, 2 * size])).tolist()
        assert a != b


def test_a_session_keeps_a_lower_batch_size(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "1000b")
        shared.bound_batches(spark)
        assert spark.conf.get(key).rstrip("b") == "1000"
    finally:
        spark.conf.set(key, before)


def test_a_hot_key_of_a_grouped_join_is_split(spark):
    settings = {"autoBroadcastJoinThreshold": "-1", "adaptive.autoBroadcastJoinThreshold": "-1", "adaptive.skewJoin.skewedPartitionThresholdInBytes": "2000", "adaptive.skewJoin.skewedPartitionFactor": "2", "adaptive.advisoryPartitionSizeInBytes": "2000"}
    before = {f"spark.sql.{k}": spark.conf.get(f"spark.sql.{k}", None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(f"spark.sql.{k}", v)
        rows = spark.range(0, 20_000, 1, 8).select(F.when(F.col("id") < 10_000, -7).otherwise(F.col("id")).alias("k"), F.hash("id").alias("v"))
        got = rows.join(shared.grouped(rows, "k", F.count("*").alias("n"), F.max("v").alias("most")), "k")
        assert got.columns == ["k", "v", "n", "most"]
        found = got.collect()
        plan = got._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert "skew=true" in plan
    assert len(found) == 20_000 and {r["k"]: r["n"] for r in found} == {-7: 10_000, **{k: 1 for k in range(10_000, 20_000)}}
    assert all(r["most"] == r["v"] for r in found if r["k"] >= 0) and {r["most"] for r in found if r["k"] < 0} == {max(r["v"] for r in found if r["k"] < 0)}
