"""Loading and checking a product catalogue: items by position, and an index from code to items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ITEM = "id int, leaf string, name string, desc string, layer string, price double, rank int, bc array<string>"
ITEMS = "item_id int, leaf string, name string, desc string, layer string, price double, rank int, bc array<string>"
CODES = "code string, p int, c int, m array<int>"
SCANS = "device_id long, seq long, t_ms long, code string, known boolean"
HISTORY = "device_id long, seq long, code string, status string, item_id int, t_ms long"
DATABASE = f"items array<struct<{ITEM.replace(' ', ':').replace(',:', ',')}>>, barcodes map<string, struct<p:int,c:int,m:array<int>>>"
LAYERS = ("a", "b", "c", "?")


def parse(database: Column) -> Column:
    """A database as JSON text; absent fields are null, and of repeated keys the last holds."""
    return F.from_json(database, f"struct<{_as_type(DATABASE)}>")


def _as_type(schema: str) -> str:
    from pyspark.sql.types import StructType

    return StructType.fromDDL(schema).simpleString()[len("struct<") : -1]


def from_base64(text: Column) -> Column:
    return F.unbase64(text)


def load_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(items with their position, codes) of a JSON database of items and barcodes."""
    whole = spark.read.schema(DATABASE).option("multiLine", True).json(path)
    return unpacked(whole)


def unpacked(whole: DataFrame) -> tuple[DataFrame, DataFrame]:
    items = whole.select(F.posexplode("items").alias("position", "it")).select("position", F.col("it.id").alias("item_id"), *(f"it.{c}" for c in ("leaf", "name", "desc", "layer", "price", "rank", "bc")))
    codes = whole.select(F.explode("barcodes").alias("code", "r")).select("code", "r.p", "r.c", "r.m")
    return items, codes


def write(items: DataFrame, codes: DataFrame, path: str) -> None:
    """Parquet tables; what a search looks in is stored with the items, so that its filters reach the scan."""
    from scanweft.functions.texts import haystack

    items.withColumn("hay", haystack(F.col("name"), F.col("desc"))).write.mode("overwrite").parquet(f"{path}/items")
    codes.write.mode("overwrite").parquet(f"{path}/codes")


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/items"), spark.read.parquet(f"{path}/codes")


def problems(items: DataFrame, codes: DataFrame) -> DataFrame:
    """What is wrong with a catalogue, a row each: (kind, ref). Bad rows are reported, none is dropped."""
    at = F.col("position") if "position" in items.columns else None
    found = [
        items.groupBy("item_id").count().where("count > 1").select(F.lit("item id repeats").alias("kind"), F.col("item_id").cast("string").alias("ref")),
        items.where("leaf is null").select(F.lit("no leaf"), F.col("item_id").cast("string")),
        items.where(~F.coalesce(F.col("layer").isin(*LAYERS), F.lit(False))).select(F.lit("unknown layer"), F.col("item_id").cast("string")),
        codes.groupBy("code").count().where("count > 1").select(F.lit("code repeats"), "code"),
    ]
    if at is not None:
        found.append(items.where(~at.eqNullSafe(F.col("item_id"))).select(F.lit("item id is not its position"), F.col("item_id").cast("string")))
    uses = codes.select("code", F.explode(F.concat(F.array("p", "c"), F.coalesce("m", F.array().cast("array<int>")))).alias("item_id")).where("item_id is not null")
    found.append(uses.join(items.select("item_id").distinct(), "item_id", "left_anti").select(F.lit("code names no item"), "code").distinct())
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out
