"""Embedding near-duplicates by collision-counting projections (operator 10).

Equal vectors are one class. Classes are dealt into blocks by the signs of random projections around their
medians, in several rounds; depth follows the number of classes, so a block stays a few hundred however
many rows there are. Within a block, many one-dimensional projections are sorted; a query's window in each
holds what lies within `width` of it, and each pair counts the windows it shares. Pairs with enough
collisions are verified by their cosine in double precision. The number of rounds is calibrated on a
bounded sample of each length of vectors: vectors at exactly the threshold are made from sampled ones, and rounds
are added until the wanted share of such pairs meets in a block and passes the count. Where the most
rounds don't reach it, as with vectors that lie close together, blocks get fewer signs and so grow, down to one
block of all. Every row is indexed and queried.

A pair counts in the first round whose block it shares, so nothing about pairs leaves a task: only each
class's number of links and a spanning forest of them. For that a tile needs its vectors, so every round sends them
once through a shuffle; they are stored in no table between, and the signs of all rounds go with them as bits. Blocks
of more than PART classes are split into parts whose pairs are spread over tasks.

Defined results: pairs at exactly the threshold link; vectors that are null, empty, zero or hold null or non-finite components, and rows with a null
id, link with nothing; vectors of different length never link; rows that repeat an id count as further
vectors; very long vectors are compared whole; an empty table gives no rows; other columns, of whatever name, are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanweft.llm.components import components, forest
from scanweft.llm.shared import arrow_rows, column, stored

SAMPLE = 2048
PART = 1024
PROJECTIONS = 32
MOST_ROUNDS = 400
#: Split blocks up to which their table is broadcast (under 100 bytes each in memory).
BROADCAST_BLOCKS = 100_000
BLOCK_ROWS = 640
BLOCK = "round int, dim int, block long"
_BLOCK = {"round": pa.int32(), "dim": pa.int32(), "block": pa.int64()}
_OWN = {"rep": pa.int64(), "copies": pa.int64(), "vector": pa.binary(), "signs": pa.binary()}


@lru_cache(8)
def _planes(seed: int, count: int, dim: int) -> np.ndarray:
    return np.random.default_rng([seed, dim, 1]).standard_normal((count, dim))


class Plan(NamedTuple):
    """What the sample of the vectors of one length has settled; equal everywhere."""

    dim: int
    medians: np.ndarray
    bits: int
    rounds: int
    width: float
    least: int
    threshold: float
    seed: int

    def lines(self, dim: int) -> np.ndarray:
        return np.random.default_rng([self.seed, dim, 2]).standard_normal((PROJECTIONS, dim))

    def signs(self, x: np.ndarray) -> np.ndarray:
        """The sides of all planes that each unit vector is on, eight to a byte."""
        return np.packbits(x @ _planes(self.seed, self.rounds * self.bits, x.shape[1]).T > self.medians, axis=1)

    def keys(self, signs: np.ndarray) -> np.ndarray:
        """The block of each unit vector in every round, by its signs."""
        if not self.bits:
            return np.zeros((len(signs), self.rounds), np.int64)
        sides = np.unpackbits(signs, axis=1, count=self.rounds * self.bits).reshape(len(signs), self.rounds, self.bits)
        return sides @ (1 << np.arange(self.bits, dtype=np.int64))


def _binomial_tail(n: int, p: float, k: int) -> float:
    return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k, n + 1))


def calibrated(sample: np.ndarray, classes: int, threshold: float, recall: float, seed: int) -> Plan:
    """sample: unit vectors. The least rounds with which pairs at the threshold are found with `recall`, in the
    smallest blocks for which MOST_ROUNDS are enough."""
    dim = sample.shape[1]
    sigma = math.sqrt(2 - 2 * threshold)  # of the difference of two unit vectors' projections
    width = sigma
    inside = math.erf(width / sigma / math.sqrt(2))
    least = max(k for k in range(PROJECTIONS + 1) if _binomial_tail(PROJECTIONS, inside, k) >= 1 - (1 - recall) / 4)
    bits = max(0, math.ceil(math.log2(max(1, classes) / BLOCK_ROWS)))
    exact = Plan(dim, np.zeros(0), 0, 1, width, least, threshold, seed)
    if not bits:
        return exact
    rng = np.random.default_rng([seed, 3])
    away = rng.standard_normal(sample.shape)
    away -= (away * sample).sum(axis=1, keepdims=True) * sample
    away /= np.maximum(np.linalg.norm(away, axis=1, keepdims=True), 1e-12)
    twins = threshold * sample + math.sqrt(1 - threshold**2) * away
    for bits in range(bits, 0, -1):
        plan = Plan(dim, np.zeros(MOST_ROUNDS * bits), bits, MOST_ROUNDS, width, least, threshold, seed)
        planes = _planes(seed, MOST_ROUNDS * bits, dim)
        met, rounds, medians = np.zeros(len(sample), bool), 0, []
        while rounds < MOST_ROUNDS and met.mean() < 1 - (1 - recall) / 2:
            own = planes[rounds * bits : (rounds + 1) * bits]
            at = sample @ own.T
            medians.append(np.median(at, axis=0))
            met |= ((at > medians[-1]) == (twins @ own.T > medians[-1])).all(axis=1)
            rounds += 1
        if met.mean() >= 1 - (1 - recall) / 2:
            return plan._replace(medians=np.concatenate(medians), rounds=rounds)
    return exact


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def tile_links(x: np.ndarray, keys: np.ndarray, side: np.ndarray, this_round: int, plan: Plan) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of linked unit vectors that meet in this block and in none of an earlier round.

    side: 0 in both parts' place, else pairs are of side 1 with side 2 only.
    """
    n = len(x)
    at = x @ plan.lines(x.shape[1]).T
    ranks, los, his = [], [], []
    for p in range(at.shape[1]):
        order = np.argsort(at[:, p], kind="stable")
        line = at[order, p]
        rank = np.empty(n, np.int32)
        rank[order] = np.arange(n, dtype=np.int32)
        ranks.append(rank)
        los.append(np.searchsorted(line, at[:, p] - plan.width, side="left").astype(np.int32))
        his.append(np.searchsorted(line, at[:, p] + plan.width, side="right").astype(np.int32))
    for first in range(0, n, 128):
        own = slice(first, min(n, first + 128))
        count = np.zeros((own.stop - first, n), np.uint8)
        for rank, lo, hi in zip(ranks, los, his, strict=True):
            # within the window: unsigned, so that one comparison tests both ends
            count += (rank[None, :] - lo[own, None]).astype(np.uint32) < (hi[own, None] - lo[own, None]).astype(np.uint32)
        i, j = np.nonzero(count >= plan.least)
        i += first
        ok = (j > i) & ((side[i] == 0) | (side[i] != side[j]))
        i, j = i[ok], j[ok]
        for at_pair in range(0, len(i), 40_000):
            a, b = i[at_pair : at_pair + 40_000], j[at_pair : at_pair + 40_000]
            near = np.einsum("ij,ij->i", x[a], x[b]) >= plan.threshold
            a, b = a[near], b[near]
            if this_round:
                new = ~(keys[a, :this_round] == keys[b, :this_round]).any(axis=1)
                a, b = a[new], b[new]
            if len(a):
                yield a, b


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, recall: float = 0.98, seed: int = 11, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per vector: vec_id, n_links, component_id, kept."""
    rows = stored(vectors.select(column(id_col).cast("long").alias("vec_id"), column(vector_col).alias("v")), "vectors")
    wide = rows.schema["v"].dataType.simpleString() != "array<float>"
    dtype = np.dtype("<f8" if wide else "<f4")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    valid = F.coalesce(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0), F.lit(False))
    classes = stored(rows.where(valid).groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "vector-classes")
    lone = rows.where(~valid).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    lengths = {r["d"]: r["c"] for r in classes.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("c")).collect()}  # one number per length
    if not lengths:
        return lone

    def planned(dim: int, count: int) -> Plan:
        if count <= BLOCK_ROWS:  # one block, whatever is sampled
            return calibrated(np.zeros((0, dim)), count, threshold, recall, seed)
        sampled = classes.where(F.size("v") == dim).orderBy(F.xxhash64("rep"), "rep").select("v").limit(SAMPLE).collect()  # bounded
        return calibrated(_unit(np.array([r[0] for r in sampled], np.float64)), count, threshold, recall, seed)

    plans = {dim: planned(dim, count) for dim, count in lengths.items()}

    def dealt(wide: bool):
        """A row for each vector and round: its block, and with it the vector and its signs."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, 1000):
                    batch = whole.slice(at, 1000)
                    lists = batch.column(0)
                    dims = np.diff(lists.offsets.to_numpy())
                    for dim in np.unique(dims).tolist():
                        mine = np.flatnonzero(dims == dim)
                        x = lists.take(pa.array(mine)).flatten().to_numpy(zero_copy_only=False).reshape(len(mine), dim)
                        signs = plans[dim].signs(_unit(x))
                        keys = plans[dim].keys(signs)
                        own = {}
                        if wide:
                            own = {"rep": batch.column(1).take(pa.array(mine)), "copies": batch.column(2).take(pa.array(mine)), "vector": [r.tobytes() for r in x.astype(dtype)], "signs": [k.tobytes() for k in signs]}
                        for r in range(plans[dim].rounds):
                            yield arrow_rows({"round": np.full(len(mine), r), "dim": np.full(len(mine), dim), "block": keys[:, r], **own}, _BLOCK | (_OWN if wide else {}))

        return run

    # only blocks that are split are looked up; the vectors go from the scan to their tiles, stored nowhere between
    counts = classes.select("v").mapInArrow(dealt(False), BLOCK).groupBy("round", "dim", "block").agg(F.count("*").alias("c"))
    large = stored(counts.where(F.col("c") > PART).select(F.col("round").alias("r"), F.col("dim").alias("d"), F.col("block").alias("b"), F.ceil(F.col("c") / PART).cast("int").alias("parts")), "large-blocks")
    few = large.count() <= BROADCAST_BLOCKS
    parted = classes.select("v", "rep", "copies").mapInArrow(dealt(True), f"{BLOCK}, rep long, copies long, vector binary, signs binary")
    parted = parted.join(F.broadcast(large) if few else large, (F.col("round") == F.col("r")) & (F.col("dim") == F.col("d")) & (F.col("block") == F.col("b")), "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    parted = parted.withColumn("part", F.pmod(F.xxhash64("rep"), "parts").cast("int"))
    tiled = parted.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    tiled = tiled.withColumn("i", F.least("part", "k")).withColumn("j", F.greatest("part", "k")).withColumn("side", F.when(F.col("i") == F.col("j"), 0).when(F.col("part") == F.col("i"), 1).otherwise(2))
    key = ["round", "dim", "block", "i", "j"]
    out = {"rep": pa.int64(), "links": pa.int64(), "to": pa.int64()}

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.column_stack([batch.column(k).to_numpy() for k in key])
            cut = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(keys)], strict=True):
                if at != (now := tuple(keys[a].tolist())):
                    yield from links_of(at, held)
                    at, held = now, []
                held.append(batch.slice(a, b - a))
        yield from links_of(at, held)

    def links_of(at: tuple | None, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if at is None:
            return
        tile = pa.Table.from_batches(held).combine_chunks()
        rep, copies, side = (tile.column(c).to_numpy() for c in ("rep", "copies", "side"))
        if len(rep) < 2:
            return
        plan = plans[at[1]]
        x = _unit(np.frombuffer(b"".join(tile.column("vector").to_pylist()), dtype).reshape(len(rep), at[1]))
        keys = plan.keys(np.frombuffer(b"".join(tile.column("signs").to_pylist()), np.uint8).reshape(len(rep), -(-plan.rounds * plan.bits // 8)))
        links, a_all, b_all = np.zeros(len(rep), np.int64), [], []
        for a, b in tile_links(x, keys, side, at[0], plan):
            np.add.at(links, a, copies[b])
            np.add.at(links, b, copies[a])
            a, b = forest(a, b)
            a_all.append(a)
            b_all.append(b)
        some = np.flatnonzero(links)
        if len(some):
            a, b = forest(np.concatenate(a_all), np.concatenate(b_all))
            to = np.arange(len(rep))
            to[a] = b
            yield arrow_rows({"rep": rep[some], "links": links[some], "to": rep[to[some]]}, out)

    found = stored(tiled.select(*key, "side", "rep", "copies", "vector", "signs").repartition(*key).sortWithinPartitions(*key).mapInArrow(compare, "rep long, links long, to long"), "vector-links")
    parts = components(found.select(F.col("rep").alias("a"), F.col("to").alias("b")))
    of = classes.join(found.groupBy("rep").agg(F.sum("links").alias("links")), "rep", "left").join(parts.withColumnRenamed("node", "rep"), "rep", "left")
    of = of.select("v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    linked = rows.where(valid).join(of, "v").select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    return linked.union(lone)
