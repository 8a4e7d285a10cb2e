"""Mixture-controlled packing (operator 7): deficit round-robin over source queues.

Each source is a queue of its documents' ids. A round is a window of `window` tokens: every queue's credit grows by
its share of the window, the queue gives the whole tokens of its credit, and the fraction is carried as its deficit
to the next window, however far on and in whichever partition. So every window holds every source within two
tokens of its target (by default its share of all tokens), and the total so far is as near, to the end.

The rounds have a closed form. With c(s) the shares of the queues up to s together, as 32-bit fractions, the queues up
to s have given floor(k * window * c(s)) tokens in the first k windows; two such numbers bound what one queue has
given. So a document's pieces follow from its place in its queue alone, without a pass over windows in order.
When a queue can't fill its part of a further window, the others go on in their proportions; what no full round can
take comes at the end, back to back, and only the last window is not full.

A source that is owed less than two tokens a window shares one queue with others like it, one after another, so
there are at most window / 2 + 1 queues however many sources there are.

Texts are encoded once, partitioned by ranges of (source, id), so a hot source spans many tasks; the
ids are stored. Totals per partition and source give each document its place in its queue.

Defined results: a null text is empty and has only the end id; very long texts are encoded whole; a null source is a
queue of its own; rows with a null id, and rows that repeat an id, are all packed, in order of their texts (equal ones
in any order, as they are alike); an empty table gives no rows; other columns, of whatever name, are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scanweft.llm.encoding import encoder
from scanweft.llm.shared import arrow_rows, column, steps, stored, texts

WINDOW = 2048
#: Rows (a partition and a source each) up to which the table of totals is broadcast, at 48 bytes a row.
BROADCAST_ROWS = 200_000
#: The whole, of which shares are parts.
WHOLE = 1 << 32
ENCODED = "part int, start long, source string, doc_id long, n long, ids binary"
_ENCODED = {"part": pa.int32(), "start": pa.int64(), "source": pa.string(), "doc_id": pa.int64(), "n": pa.int64(), "ids": pa.binary()}
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"
_PIECES = {"doc_id": pa.int64(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "doc_tokens": pa.int64(), "sequence_id": pa.int64(), "offset": pa.int64(), "source": pa.string()}


def due(bound: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """floor(tokens * bound / WHOLE), in two steps that stay within 64 bits for up to 2**50 tokens."""
    return ((tokens >> 20) * bound + ((tokens & ((1 << 20) - 1)) * bound >> 20)) >> 12


def apportioned(weights: list[int], window: int) -> np.ndarray:
    """0, c(0), c(0) + c(1) and so on to WHOLE: shares near the weights', each worth at least a token a window."""
    least, total = -(-WHOLE // window), sum(weights)
    share = [max(least, w * WHOLE // total) for w in weights]
    spare = WHOLE - sum(share)
    for s in sorted(range(len(share)), key=lambda s: -share[s]):
        change = max(spare, least - share[s])
        share[s] += change
        spare -= change
    return np.concatenate([[0], np.cumsum(np.array(share, np.int64))])


class Phase(NamedTuple):
    """Windows that the same queues fill."""

    window: int  # the first
    windows: int
    bounds: np.ndarray  # of the queues, by number: c up to each, and beside it c with it; equal for those that are dry
    begun: np.ndarray  # tokens that each queue has given before

    def given(self, queue: np.ndarray, k: np.ndarray, size: int) -> np.ndarray:
        """Tokens of each queue in the first k windows of the phase."""
        return due(self.bounds[1][queue], k * size) - due(self.bounds[0][queue], k * size)


def phases(amounts: np.ndarray, size: int, weights: np.ndarray | None = None) -> tuple[list[Phase], np.ndarray, int]:
    """All phases, what each queue has given in them, and the windows that they fill."""
    given, at, out = np.zeros(len(amounts), np.int64), 0, []
    live = np.flatnonzero(amounts)
    while len(live) and int((amounts - given)[live].sum()) >= size:
        left = (amounts - given)[live]
        cum = apportioned([int(x) for x in (left if weights is None else weights[live])], size)
        bounds = np.zeros((2, len(amounts)), np.int64)
        bounds[0, live], bounds[1, live] = cum[:-1], cum[1:]
        windows = min((int(n) + 2) * WHOLE // (size * int(c)) for n, c in zip(left, np.diff(cum), strict=True)) + 1
        phase = Phase(at, windows, bounds, given.copy())
        while (phase.given(live, np.int64(windows), size) > left).any():
            windows -= 1
        short = phase.given(live, np.int64(windows + 1), size) > left
        if windows:
            out.append(phase._replace(windows=windows))
            given[live] += phase.given(live, np.int64(windows), size)
            at += windows
        if weights is not None or not windows:
            live = live[~short]
        live = live[(amounts - given)[live] > 0]
    return out, given, at


def encode_queues(docs: DataFrame, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """A stored row per document in queue order: partition, ids before it there, source, id, ids of 16 or, where one needs them, 32 bits."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, start = encoder(tokenizer, "<u2" if end_id < 1 << 16 else "<u4"), TaskContext.get().partitionId(), 0
        end, width = np.array([end_id], coder.dtype).tobytes(), coder.dtype.itemsize
        for step in steps(batches):
            ids = [x + end for x in coder.encode(step.column(2).to_pylist())]
            n = np.array([len(x) // width for x in ids], np.int64)
            yield arrow_rows({"part": np.full(len(n), part, np.int32), "start": start + np.cumsum(n) - n, "source": step.column(0), "doc_id": step.column(1), "n": n, "ids": pa.array(ids, pa.binary())}, _ENCODED)
            start += int(n.sum())

    named = texts(docs, column(source_col).cast("string").alias("source"), column(id_col).cast("long").alias("doc_id"), text=text_col)
    ordered = named.repartitionByRange("source", "doc_id").sortWithinPartitions("source", "doc_id", "text")
    return stored(ordered.mapInArrow(encode, ENCODED), "queues", compression="zstd")


def _queues(sums: DataFrame, window: int, mixture: dict[str | None, float] | None) -> tuple[DataFrame, np.ndarray, np.ndarray | None]:
    """The sources with a queue of their own, by number; the amount of every queue, the shared one last; and its weight."""
    if mixture is not None:
        spark = sums.sparkSession
        weighed = spark.createDataFrame([(s, max(1, round(1e6 * w / max(mixture.values())))) for s, w in mixture.items() if w > 0], "of string, w long")
        sums = sums.join(F.broadcast(weighed), F.col("source").eqNullSafe(F.col("of")), "left").drop("of")  # as long as the caller's own dict
        if missing := [r[0] for r in sums.where("w is null").select("source").limit(10).collect()]:
            raise ValueError(f"sources without a positive proportion: {missing}")
    else:
        sums = sums.withColumn("w", F.col("n"))
    total, weight = sums.agg(F.sum("n"), F.sum("w")).first()
    large = [(r["source"], r["n"], r["w"]) for r in sums.where(F.col("w") * window >= 2 * (weight or 0)).collect()]  # window / 2 at most
    large.sort(key=lambda r: r[1])
    pool, pooled = (total or 0) - sum(r[1] for r in large), (weight or 0) - sum(r[2] for r in large)
    while large and pool and pooled * window < 2 * weight:  # those that share a queue are worth one of their own
        _, n, w = large.pop(0)
        pool, pooled = pool + n, pooled + w
    large.sort(key=lambda r: (r[0] is not None, r[0] or ""))
    names = sums.sparkSession.createDataFrame([(r[0], i) for i, r in enumerate(large)], "of string, queue int")
    amounts = np.array([*(r[1] for r in large), pool], np.int64)
    return names, amounts, None if mixture is None else np.array([*(r[2] for r in large), pooled], np.int64)


def pack(encoded: DataFrame, window: int = WINDOW, mixture: dict[str | None, float] | None = None) -> DataFrame:
    """The pieces of every document of encode_queues, each in its sequence and offset.

    mixture: the target proportion of every source; the default is its share of all tokens, which lasts to the
    end. With others, a source that runs dry leaves its share to the rest, in their proportions.
    """
    # one row per partition and source; a source that spans partitions continues where the one before ended
    parts = stored(encoded.groupBy("part", "source").agg(F.sum("n").alias("n"), F.min("start").alias("first")), "queue-parts")
    names, amounts, weights = _queues(parts.groupBy("source").agg(F.sum("n").alias("n")), window, mixture)
    plan, given, full = phases(amounts, window, weights)
    left = amounts - given
    tail = full * window + np.cumsum(left) - left - given  # from a place in a queue to its place in the end

    own = parts.join(F.broadcast(names), F.col("source").eqNullSafe(F.col("of")), "left").select("part", "source", "n", "first", F.coalesce("queue", F.lit(len(amounts) - 1)).alias("queue"))
    before = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = own.groupBy("queue", "part").agg(F.sum("n").alias("s")).select(F.col("queue").alias("q"), F.col("part").alias("p"), F.coalesce(F.sum("s").over(before.partitionBy("queue")), F.lit(0)).alias("earlier"))
    within = Window.partitionBy("queue", "part").orderBy(F.asc_nulls_first("source")).rowsBetween(Window.unboundedPreceding, -1)
    own = own.withColumn("here", F.coalesce(F.sum("n").over(within), F.lit(0))).join(sums, (F.col("queue") == F.col("q")) & (F.col("part") == F.col("p")))
    bases = own.select(F.col("part").alias("b_part"), F.col("source").alias("b_source"), "queue", (F.col("earlier") + F.col("here") - F.col("first")).alias("base"))
    if parts.count() <= BROADCAST_ROWS:
        bases = F.broadcast(bases)
    begun = encoded.join(bases, (F.col("part") == F.col("b_part")) & F.col("source").eqNullSafe(F.col("b_source")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                yield from cut_rows(batch.slice(at, 500))

    def cut_rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        queue, begin, n = (batch.column(c).to_numpy().astype(np.int64) for c in ("queue", "begin", "n"))
        found = [stretches(phase, queue, begin, n, window) for phase in plan]
        # what no round takes, cut where a window ends
        first = np.maximum(begin, given[queue])
        a, b = first + tail[queue], begin + n + tail[queue]
        row, k = spread(a // window, np.where(b > a, -(-b // window), a // window))
        lo, hi = np.maximum(a[row], k * window), np.minimum(b[row], (k + 1) * window)
        found.append((row, lo - tail[queue][row], hi - lo, lo))
        row, lo, length, place = (np.concatenate(x) for x in zip(*found, strict=True))
        start = lo - begin[row]
        raw = [np.frombuffer(x.as_buffer(), "<u2" if len(x.as_buffer()) == 2 * t else "<u4").astype("<u4") for x, t in zip(batch.column("ids"), n.tolist(), strict=True)]
        crc = [zlib.crc32(raw[r][s : s + k]) for r, s, k in zip(row.tolist(), start.tolist(), length.tolist(), strict=True)]
        yield arrow_rows({"doc_id": batch.column("doc_id").take(pa.array(row)), "start": start, "length": length, "ids_crc32": crc, "doc_tokens": n[row], "sequence_id": place // window, "offset": place % window, "source": batch.column("source").take(pa.array(row))}, _PIECES)

    return begun.select("source", "doc_id", "n", "ids", "queue", (F.col("start") + F.col("base")).alias("begin")).mapInArrow(cut, PIECES)


def spread(first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the numbers from first to before end: the rows, and the numbers."""
    many = np.maximum(0, end - first)
    row = np.repeat(np.arange(len(many)), many)
    return row, first[row] + np.arange(len(row)) - (np.cumsum(many) - many)[row]


def stretches(phase: Phase, queue: np.ndarray, begin: np.ndarray, n: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """The pieces that a phase takes of stretches of queues: row, place in the queue, length, place in all windows."""
    own = phase.begun[queue]
    last = phase.given(queue, np.int64(phase.windows), size)
    lo, hi = np.clip(begin - own, 0, last), np.clip(begin + n - own, 0, last)
    some = np.flatnonzero(hi > lo)
    queue, lo, hi, own = queue[some], lo[some], hi[some], own[some]

    def window_of(token: np.ndarray) -> np.ndarray:
        share = (phase.bounds[1] - phase.bounds[0])[queue].astype(np.float64)
        k = np.clip((token / share * (WHOLE / size)).astype(np.int64), 0, phase.windows - 1)
        while (late := phase.given(queue, k, size) > token).any():
            k = k - late
        while (early := phase.given(queue, k + 1, size) <= token).any():
            k = k + early
        return k

    row, k = spread(window_of(lo), window_of(hi - 1) + 1)
    q, from_, to = queue[row], phase.given(queue[row], k, size), phase.given(queue[row], k + 1, size)
    a, b = np.maximum(lo[row], from_), np.minimum(hi[row], to)
    real = b > a
    row, k, q, a, b, from_ = (x[real] for x in (row, k, q, a, b, from_))
    ahead = due(phase.bounds[0][q], (k + 1) * size) - due(phase.bounds[0][q], k * size)  # of the queues before it, in this window
    return some[row], own[row] + a, b - a, (phase.window + k) * size + ahead + a - from_
