"""Connected components of a link table by alternating large and small stars.

Links stay distributed. Each task first contracts the links it holds to a spanning forest; then the star
steps, each a grouped minimum with partial sums and a join, move every node to the smallest one it can
reach until nothing changes. Rounds are written to the shared folder, so lineage stays short and a lost
executor costs one round. A node with very many links is a large group only in joins that Spark can split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanweft.llm.shared import arrow_rows, grouped, stored

_LINK = {"a": pa.int64(), "b": pa.int64()}


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stars (node, smallest node of its component) that connect what the links connect."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while True:  # hook the larger root under the smaller, then shorten all paths
        low, high = np.minimum(root[left], root[right]), np.maximum(root[left], root[right])
        apart = low != high
        if not apart.any():
            break
        np.minimum.at(root, high[apart], low[apart])
        while (root[root] != root).any():
            root = root[root]
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        a = np.concatenate([a, batch.column(0).to_numpy()])
        b = np.concatenate([b, batch.column(1).to_numpy()])
        if len(a) > 2_000_000:
            x, y = forest(a, b)
            if len(x) > len(a) // 2:  # a forest that stays large goes out, to be joined up by the star steps
                yield arrow_rows({"a": x, "b": y}, _LINK)
                a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
            else:
                a, b = x, y
    if len(a):
        x, y = forest(a, b)
        yield arrow_rows({"a": x, "b": y}, _LINK)


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _written(links: DataFrame) -> DataFrame:
    """A round, in fewer files than there are shuffle partitions: links are few beside the rows that they join. What
    comes before keeps its tasks."""
    return stored(links.repartition(max(16, int(links.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8)), "links")


def components(links: DataFrame) -> DataFrame:
    """From links (a, b) the table (node, component) of all nodes that aren't the smallest of theirs."""
    links = links.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b")
    now = _written(links.mapInArrow(_contract, "a long, b long").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = _state(now)
    while state[0]:
        both = now.union(now.select("b", "a"))
        least = grouped(both, "a", F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = grouped(large, "a", F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("l")).select(F.col("l.b").alias("a"), F.col("l.m").alias("b"))
        now = _written(small.where("a <> b").distinct())
        before, state = state, _state(now)
        if state == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
