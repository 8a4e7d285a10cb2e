"""Keyword search: all terms must stand in name or description; ranked, first 40.

The order is total: rank (unranked last), layer a first, shorter names first, then the item's id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanweft.functions import texts

LIMIT = 40
#: Terms up to which all of them are broadcast to the items; beyond, both sides meet on a gram of each term.
BROADCAST_TERMS = 20_000
GRAM = 3


def _hay(items: DataFrame) -> Column:
    return F.col("hay") if "hay" in items.columns else texts.haystack(F.col("name"), F.col("desc"))


def _order() -> list[Column]:
    return [texts.rank_or_last(F.col("rank")), F.col("layer").eqNullSafe("a").cast("int").desc(), texts.utf16_length(F.coalesce("name", F.lit(""))), F.col("item_id")]


def parsed(query: str) -> list[str]:
    """The terms of one search, as functions.texts.terms has them."""
    white = "\t\n\x0b\f\r                  　﻿"
    words = query.strip(white).lower()
    return list(dict.fromkeys("".join(" " if c in white else c for c in words).split(" "))) if words else []


def matches(items: DataFrame, query: str) -> DataFrame:
    """Items with all terms; none for an empty search."""
    found = [t for t in parsed(query) if t]
    if not found:
        return items.where(F.lit(False))
    return items.where(reduce(lambda a, b: a & b, [F.contains(_hay(items), F.lit(t)) for t in found]))


def top(items: DataFrame, query: str, limit: int = LIMIT) -> DataFrame:
    return matches(items, query).orderBy(*_order()).limit(limit)


def hit_count(items: DataFrame, query: str) -> DataFrame:
    return matches(items, query).agg(F.count("*").alias("n_hits"))


def matches_of_many(queries: DataFrame, items: DataFrame) -> DataFrame:
    """(query_id, item) for every search and every item with all its terms.

    No lambda spans both sides: terms are rows, and an item counts those it holds.
    """
    wanted = queries.select("query_id", texts.terms(F.col("q")).alias("ts")).select("query_id", F.size("ts").alias("n_terms"), F.explode("ts").alias("term")).where("term <> ''")
    wanted = wanted.withColumn("n_terms", F.count("*").over(Window.partitionBy("query_id")))
    hay = items.select("item_id", _hay(items).alias("__hay"))
    if wanted.count() <= BROADCAST_TERMS:
        pairs = hay.join(F.broadcast(wanted), F.contains("__hay", "term"))
    else:
        grams = hay.select("item_id", "__hay", F.explode(F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.length("__hay")), lambda i: F.transform(F.sequence(F.lit(1), F.lit(GRAM)), lambda n: F.substr("__hay", i, n)))))).alias("gram"))
        keyed = wanted.withColumn("gram", F.substring("term", 1, GRAM))
        pairs = grams.join(keyed, "gram").where(F.contains("__hay", "term"))
    held = pairs.groupBy("query_id", "item_id").agg(F.count("*").alias("n"), F.first("n_terms").alias("n_terms")).where("n = n_terms").select("query_id", "item_id")
    return held.join(items, "item_id")


def top_of_many(queries: DataFrame, items: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The first items of every search, with their place and the number of hits."""
    found = matches_of_many(queries, items)
    counts = found.groupBy("query_id").agg(F.count("*").alias("n_hits"))
    w = Window.partitionBy("query_id").orderBy(*_order())
    return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit).join(counts, "query_id")


def rows(found: DataFrame) -> DataFrame:
    """The fields of a list of results."""
    return found.select(
        *(c for c in ("query_id", "place", "n_hits") if c in found.columns),
        "item_id",
        texts.clean_leaf(F.col("leaf")).alias("title"),
        texts.price_text(F.col("price")).alias("price_text"),
        texts.layer_label_in_list(F.col("layer")).alias("layer_label"),
        texts.badge(F.col("rank"), texts.BEST_SELLER_SHORT).alias("badge"),
        texts.first_barcode(F.col("bc")).alias("barcode"),
    )
