"""Pieces that the training-data operators share: the shared folder, Arrow slices, vectorised words.

Words are maximal runs of bytes other than space and \\t \\n \\v \\f \\r. UTF-8 never uses those bytes
inside a longer character, so splitting bytes and splitting code points give the same words.
Texts are handled as one buffer of bytes and an array of offsets, whole and without per-row loops.
"""

from __future__ import annotations

import ctypes
import sys
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step handles; a longer text is a step of its own.
STEP_BYTES = 2 << 20
#: Bytes that the hashes of ranges are worked out for in one go; a longer range is one of its own.
STRETCH_BYTES = 1 << 17

_LIBC = ctypes.CDLL(None) if sys.platform == "linux" and hasattr(ctypes.CDLL(None), "malloc_trim") else None

#: Bytes of an Arrow batch from Spark, about.
BATCH_BYTES = 4 << 20

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where unset (tests) a local one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="scanweft-")
        spark.conf.set("spark.checkpoint.dir", base)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return base


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df written as Parquet in the shared folder and read back: lineage ends there, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def on_disk(df: DataFrame) -> DataFrame:
    """df, kept on the executors' disks once computed, for a few uses in one operator.

    Unlike a stored table it costs no files in the shared folder. Lineage stays, and is short where this is
    used, so what a lost executor held is computed again; spark.catalog.clearCache() frees the disk.
    """
    return df.persist(StorageLevel.DISK_ONLY)


def bound_batches(spark: SparkSession) -> None:
    """Rows of texts go to Python in batches of a few MB: at the default of 64 MB, buffers of two tasks and their
    copies on both sides take a good part of a small executor. A lower setting of the session stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key).rstrip("bB")) > BATCH_BYTES:
        spark.conf.set(key, f"{BATCH_BYTES}b")


def column(name: str) -> Column:
    """The column of that very name, whatever it holds (dots are no field access)."""
    return F.col("`" + name.replace("`", "``") + "`")


def plain(df: DataFrame, *names: str) -> tuple[DataFrame, list[str]]:
    """df with its columns called c0, c1 and so on, and what the named ones are called now.

    So columns of any name (with dots, or like those of an operator) pass through a plan; toDF(*df.columns) names them again.
    """
    of = {c: f"c{i}" for i, c in enumerate(df.columns)}
    folded = {c.lower(): new for c, new in of.items()}
    return df.toDF(*of.values()), [of.get(n) or folded[n.lower()] for n in names]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """The named columns and the text as string, null as empty; other columns of docs never meet operator columns."""
    bound_batches(docs.sparkSession)
    return docs.select(*keep, F.coalesce(column(text).cast("string"), F.lit("")).alias("text"))


def grouped(rows: DataFrame, key: str, *values: Column) -> DataFrame:
    """rows grouped by a long key, to be joined with rows by that key where one key may have very many rows.

    Spark splits a partition of a join only where both sides come straight from a shuffle for it. An aggregate by the
    join's own key is joined where it was worked out, so all rows of a hot key would be one task's. Grouped by the
    key's complement, the aggregate (a row per key) is shuffled once more, and the rows of a hot key are split.
    """
    own = rows.groupBy(F.bitwise_not(key).alias("complement")).agg(*values)
    return own.select(F.bitwise_not("complement").alias(key), *(c for c in own.columns if c != "complement"))


def trim() -> None:
    """Gives memory that is free back to the system: a worker serves task after task, of one operator after another."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def steps(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds about `limit` bytes of text: memory stays bounded however rows are batched."""
    for batch in batches:
        if not batch.num_rows:
            continue
        i = batch.schema.get_field_index(column)
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(i)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            floor = size[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(size, floor + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to
    trim()


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and their n+1 offsets from 0; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, off, data = wide.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[wide.offset : wide.offset + len(wide) + 1]
    if data is None or not len(wide):
        return np.zeros(0, np.uint8), np.zeros(len(wide) + 1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]]
    return raw, offsets - offsets[0]


def words_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end (exclusive) and row of every word."""
    if not len(raw):
        e = np.zeros(0, np.int64)
        return e, e, e
    space = SPACE[raw]
    full = np.flatnonzero(offsets[1:] > offsets[:-1])
    edge = np.empty(len(raw), bool)
    edge[0], edge[1:] = True, space[:-1]
    edge[offsets[full]] = True
    starts = np.flatnonzero(edge & ~space)
    edge[-1], edge[:-1] = True, space[1:]
    edge[offsets[full + 1] - 1] = True
    ends = np.flatnonzero(edge & ~space) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


_SEED = np.random.default_rng(20240607)
_LETTERS = _SEED.integers(0, 1 << 64, 256, dtype=np.uint64)
_START = _SEED.integers(0, 1 << 64, dtype=np.uint64)
_FACTORS = np.zeros(0, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _factors(n: int) -> np.ndarray:
    """An odd factor for every place in a range, each a value of its own and no power of another."""
    global _FACTORS
    if len(_FACTORS) < n:
        out = mix(np.arange(max(n, 4096), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + _START) | np.uint64(1)
        if n > 4 * STEP_BYTES:
            return out
        _FACTORS = out
    return _FACTORS


def span_hash(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The 64-bit hash of each range of bytes; ranges ascend and don't overlap. Equal ranges have equal hashes.

    A sum over the bytes of a value of the byte times a factor of its place in the range. Factors that were powers
    of one base would let texts of a simple pattern (Thue-Morse words) collide whatever the base.
    """
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):  # in stretches that stay in a core's cache
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + STRETCH_BYTES, side="right")))
        first, last = int(starts[at]), int(ends[to - 1])
        begin, end = starts[at:to] - first, ends[at:to] - first
        own = np.arange(last - first)
        own -= np.repeat(begin, np.diff(np.append(begin, last - first)))
        # a place between two ranges is never read
        values = _LETTERS.take(raw[first:last]) * _factors(int((end - begin).max())).take(own, mode="clip")
        total = np.concatenate([values[:1] * np.uint64(0), np.cumsum(values)])
        out[at:to] = total.take(end) - total.take(begin) + (end - begin).astype(np.uint64)
        at = to
    return mix(out)


_GRAM = np.random.default_rng(77).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def gram_hash(words: np.ndarray, k: int) -> np.ndarray:
    """The hash of words[i:i+k] for every i it fits; k is at most 64."""
    n = max(0, len(words) - k + 1)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out += words[j : j + n] * _GRAM[j]
    return mix(out)


def counts_by(row: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(row, weights=weights, minlength=n).astype(np.int64)


def arrow_rows(columns: dict[str, object], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[k], type=t) if not isinstance(columns[k], pa.Array) else columns[k].cast(t) for k, t in types.items()], names=list(types))
