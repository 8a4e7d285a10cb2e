"""A bounded history of scans per device, newest first."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scanweft.functions import texts

LIMIT = 60


def recent(history: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The newest entries of each device with their place. The window's limit is applied before its shuffle."""
    w = Window.partitionBy("device_id").orderBy(F.col("t_ms").desc(), F.col("seq").desc())
    return history.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit)


def entries(outcomes: DataFrame) -> DataFrame:
    """History entries of resolved scans (with_outcome): the item's id for hits only."""
    return outcomes.select("device_id", "seq", F.col("shown_code").alias("code"), "status", F.when(F.col("status") == "hit", F.col("p")).alias("item_id"), "t_ms")


def labelled(history: DataFrame, items: DataFrame) -> DataFrame:
    """Entries with label, price and local time. Item 0 is an item; a hit whose item is gone reads as unknown."""
    of = items.select(F.col("item_id").alias("__id"), "leaf", "price")
    joined = history.join(of, (F.col("status") == "hit") & (F.col("item_id") == F.col("__id")), "left")
    found = F.col("__id").isNotNull()
    label = F.when(F.col("status") == "multi", texts.MANY_ITEMS).when(found, texts.clean_leaf(F.col("leaf"))).otherwise(texts.UNKNOWN_CODE)
    return joined.select(*history.columns, label.alias("label"), F.when(found, texts.price_text(F.col("price"))).alias("price_text"), texts.local_time(F.col("t_ms")).alias("at"))


def as_json(history: DataFrame) -> DataFrame:
    """One JSON text per device of its recent entries, newest first: c code, i null, "multi" or the item's id, t time."""
    newest = recent(history)
    item = F.when(F.col("status") == "multi", F.lit('"multi"')).when(F.col("status") == "hit", F.col("item_id").cast("string")).otherwise("null")
    entry = F.concat(F.lit('{"c":'), _quoted("code"), F.lit(',"i":'), F.coalesce(item, F.lit("null")), F.lit(',"t":'), F.col("t_ms").cast("string"), F.lit("}"))
    held = newest.groupBy("device_id").agg(F.array_sort(F.collect_list(F.struct("place", entry.alias("e")))).alias("es"))  # LIMIT at most
    return held.select("device_id", F.concat(F.lit("["), F.array_join(F.transform("es", lambda x: x["e"]), ","), F.lit("]")).alias("history"))


def _quoted(column: str):
    """A string as JSON: the value of a one-field object without its wrapping."""
    whole = F.to_json(F.struct(F.coalesce(F.col(column), F.lit("")).alias("c")))
    return F.substr(whole, F.lit(6), F.length(whole) - 6)


def from_json(text: DataFrame) -> DataFrame:
    """History entries of JSON texts (device_id, history)."""
    parsed = text.select("device_id", F.posexplode(F.from_json("history", "array<struct<c:string,i:string,t:bigint>>")).alias("place", "e"))
    status = F.when(F.col("e.i").isNull(), "miss").when(F.col("e.i") == "multi", "multi").otherwise("hit")
    return parsed.select("device_id", (F.col("place") + 1).alias("place"), F.col("e.c").alias("code"), status.alias("status"), F.when(status == "hit", F.col("e.i").cast("int")).alias("item_id"), F.col("e.t").alias("t_ms"))
