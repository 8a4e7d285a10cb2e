"""Two-pass external shuffle into shards (operator 3), by the law `key`.

Pass one scatters rows into memory-sized buckets: the shard is a jump consistent hash of the document's
id, so one more shard takes rows only into itself, and a seeded hash spreads each shard over as many
sub-buckets as its own bytes need. Equal rows have equal hashes, so those of a group that would fill a good part of a
bucket get a running number into theirs and are spread like others. Pass two reads one bucket per task, shuffles it
by Fisher-Yates with a seed of its own, and writes it as one file of the shard. Both passes depend on values alone
(which of equal rows lies where makes no difference), so a retried task writes the same rows in the same order. A
shard is its buckets one after another, which gives every row its slot; counts stay in tables.

Defined results: a null text has size 16 and checksum 0; very long texts are rows like others, so a bucket is as
large as its longest at least; rows with a null id are keyed as -1, all in one shard by the law, over as many buckets
as they need; repeated rows are all kept, each in a slot of its own; an empty table gives no rows; other columns, of
whatever name, are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scanweft.llm.shared import bound_batches, column, mix, shared_dir, stored

SHUFFLED = "doc_id long, text string, grown_shard int, shard int, sub int, pos long"
#: A bucket's share of a core's part of an executor's memory: fetched, sent to Python, sorted, permuted, sent back, sorted
#: into its shard and encoded as Parquet, it stands in memory in many forms, and garbage comes on top.
BUCKET_SHARE = 1 / 32
#: Part of a bucket from which a group of equal rows is spread.
SPREAD = 1 / 8
#: Rows up to which a table of groups or buckets is broadcast (under 100 bytes each in memory).
BROADCAST_ROWS = 100_000


def memory_sized(spark: SparkSession) -> int:
    """Bytes of text in a bucket, by the executors' settings."""
    conf = spark.sparkContext.getConf()
    size = conf.get("spark.executor.memory", "1g").lower().rstrip("b")
    unit = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}.get(size[-1], 1)
    return max(1 << 20, int(int(size.rstrip("kmgt")) * unit / int(conf.get("spark.executor.cores", "1")) * BUCKET_SHARE))


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key: from n to n+1 shards, only what goes to shard n moves."""
    state, at, ahead = keys.astype(np.uint64), np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
    todo = np.arange(len(keys))
    while len(todo):
        at[todo] = ahead[todo]
        state[todo] = state[todo] * np.uint64(2862933555777941757) + np.uint64(1)
        ahead[todo] = ((at[todo] + 1) * ((1 << 31) / ((state[todo] >> np.uint64(33)).astype(np.float64) + 1))).astype(np.int64)
        todo = todo[ahead[todo] < shards]
    return at


def fisher_yates(n: int, rng: np.random.Generator) -> np.ndarray:
    """A uniform permutation of 0..n-1."""
    out = list(range(n))
    other = (rng.random(n) * np.arange(1, n + 1)).astype(np.int64).tolist()
    for i in range(n - 1, 0, -1):
        j = other[i]
        out[i], out[j] = out[j], out[i]
    return np.array(out, np.int64)


def shard(docs: DataFrame, shards: int = 40, seed: int = 7, bucket_bytes: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes docs as shuffled shards and returns the rows of the files: doc_id, text, shard, slot, grown_shard."""

    @F.pandas_udf("shard int, grown_shard int")
    def shard_of(ids: pd.Series) -> pd.DataFrame:
        keys = mix(ids.to_numpy().astype(np.int64).view(np.uint64) + np.uint64(seed))
        return pd.DataFrame({"shard": jump_hash(keys, shards), "grown_shard": jump_hash(keys, shards + 1)})

    spark = docs.sparkSession
    bound_batches(spark)
    target = bucket_bytes or memory_sized(spark)
    rows = docs.select(column(id_col).cast("long").alias("doc_id"), column(text_col).cast("string").alias("text"))
    # the id alone goes through Python: the text stays in the JVM
    keyed = rows.withColumn("to", shard_of(F.coalesce("doc_id", F.lit(-1).cast("long")))).select("doc_id", "text", "to.shard", "to.grown_shard", F.xxhash64("doc_id", "text").alias("group"), F.monotonically_increasing_id().alias("row"))  # numbered in the scan: a retried task gives the same numbers
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 16
    groups = stored(keyed.groupBy("shard", "group").agg(F.sum(size).alias("bytes"), F.count("*").alias("rows")), "row-groups")
    many = groups.where((F.col("rows") > 1) & (F.col("bytes") > SPREAD * target)).select(F.col("group").alias("of"), F.ceil(F.col("bytes") / (SPREAD * target)).cast("long").alias("spread"))
    spread = keyed.join(F.broadcast(many) if many.count() <= BROADCAST_ROWS else many, F.col("group") == F.col("of"), "left")
    subs, buckets = {}, 0
    for r in groups.groupBy("shard").agg(F.sum("bytes").alias("bytes")).collect():  # a row per shard
        subs[r["shard"]] = (max(1, -(-int(r["bytes"]) // target)), buckets)
        buckets += subs[r["shard"]][0]
    counts = spark.createDataFrame([(k, *v) for k, v in subs.items()], "of_shard int, subs long, first long")  # as long as the number of shards asked for
    salt = F.when(F.col("spread").isNotNull(), F.pmod("row", "spread")).otherwise(0)
    placed = spread.withColumn("salt", salt).join(F.broadcast(counts), F.col("shard") == F.col("of_shard"))
    placed = placed.select("doc_id", "text", "shard", "grown_shard", F.pmod(F.xxhash64("doc_id", "text", "salt", F.lit(seed)), "subs").cast("int").alias("sub"), "first")
    scattered = placed.repartitionById(max(1, buckets), (F.col("first") + F.col("sub")).cast("int")).drop("first")

    def shuffle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One bucket: in an order that depends on its rows alone, then permuted."""
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        bucket = pa.Table.from_batches(held)
        held.clear()
        bucket = bucket.take(pa.compute.sort_indices(bucket, [("doc_id", "ascending"), ("text", "ascending")]))
        which = [bucket.column("shard")[0].as_py(), bucket.column("sub")[0].as_py()]
        order = fisher_yates(bucket.num_rows, np.random.default_rng([seed, *which]))
        for at in range(0, len(order), 2000):
            part = bucket.take(pa.array(order[at : at + 2000])).combine_chunks()
            part = part.append_column("pos", pa.array(np.arange(at, at + part.num_rows)))
            yield from part.select(["doc_id", "text", "grown_shard", "shard", "sub", "pos"]).to_batches()
        del bucket
        pa.default_memory_pool().release_unused()

    path = f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}"
    scattered.mapInArrow(shuffle, SHUFFLED).write.partitionBy("shard").parquet(path)
    files = spark.read.schema(SHUFFLED).parquet(path)
    counts = files.groupBy("shard", "sub").agg(F.count("*").alias("rows"))
    before = Window.partitionBy("shard").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)  # a row per bucket
    bases = counts.select(F.col("shard").alias("of_shard"), F.col("sub").alias("of_sub"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("base"))
    bases = F.broadcast(bases) if buckets <= BROADCAST_ROWS else bases
    placed = files.join(bases, (F.col("shard") == F.col("of_shard")) & (F.col("sub") == F.col("of_sub")))
    return placed.select("doc_id", "text", "shard", (F.col("base") + F.col("pos")).alias("slot"), "grown_shard")
