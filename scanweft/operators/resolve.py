"""Which item does a code mean? First matching candidate, then hit, conflict or miss."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanweft.functions import texts
from scanweft.functions.codes import candidates, digits

#: Characters that the field for typing a code takes.
FIELD_LENGTH = 14


def looked_up(scans: DataFrame, codes: DataFrame, raw: str = "raw") -> DataFrame:
    """scans with code (the candidate that matched, else null) and its record p, c, m; the first match wins.

    A raw code has two candidates at most, so two outer joins on the code replace exploding, joining and
    grouping again: scans are never shuffled for it where the index is small enough to broadcast by itself.
    """
    index = codes.select("code", F.struct("p", "c", "m").alias("rec"))
    one = index.select(F.col("code").alias("__one"), F.struct("code", "rec.*").alias("__first"))
    two = index.select(F.col("code").alias("__two"), F.struct("code", "rec.*").alias("__second"))
    tried = scans.withColumn("__c", candidates(F.col(raw)))
    tried = tried.withColumn("__try1", F.get("__c", F.lit(0))).withColumn("__try2", F.get("__c", F.lit(1)))
    joined = tried.join(one, F.col("__try1") == F.col("__one"), "left").join(two, F.col("__try2") == F.col("__two"), "left")
    found = F.coalesce("__first", "__second")
    return joined.select(*scans.columns, found["code"].alias("code"), found["p"].alias("p"), found["c"].alias("c"), found["m"].alias("m"))


def with_outcome(found: DataFrame, raw: str = "raw") -> DataFrame:
    """status (miss, multi or hit; an empty list of items is still multi), ok, and the code to show."""
    status = F.when(F.col("code").isNull(), "miss").when(F.col("m").isNotNull(), "multi").otherwise("hit")
    return found.withColumns({"status": status, "ok": F.col("code").isNotNull(), "shown_code": F.coalesce("code", digits(F.col(raw)))})


def typed(raw: Column) -> Column:
    """A code as the field for typing takes it: its first FIELD_LENGTH characters, trimmed; null where nothing is left."""
    return F.nullif(texts.trimmed(F.substring(raw, 1, FIELD_LENGTH)), F.lit(""))


def entered(entries: DataFrame, codes: DataFrame, raw: str = "raw") -> DataFrame:
    """Codes typed by hand with their outcome. They pass no gate, and an empty entry does nothing."""
    own = entries.withColumn(raw, typed(F.col(raw))).where(F.col(raw).isNotNull())
    return with_outcome(looked_up(own, codes, raw), raw)


def misses(found: DataFrame, codes: DataFrame, raw: str = "raw") -> DataFrame:
    """Codes that nothing matched, with the number of codes there are."""
    n = codes.agg(F.count("*").alias("n_codes"))
    return found.where(F.col("code").isNull()).withColumn("shown_code", digits(F.col(raw))).crossJoin(F.broadcast(n))  # one row


def hits(found: DataFrame, items: DataFrame) -> DataFrame:
    """Single hits with their item, and the case item if there is another one."""
    item = items.select(F.struct(*items.columns).alias("item"), F.col("item_id").alias("__item"))
    case = items.select(F.struct(*items.columns).alias("case_item"), F.col("item_id").alias("__case"))
    single = found.where(F.col("code").isNotNull() & F.col("m").isNull())
    return single.join(item, F.col("p") == F.col("__item"), "left").join(case, (F.col("c") == F.col("__case")) & (F.col("c") != F.col("p")), "left").drop("__item", "__case")


def conflicts(found: DataFrame, items: DataFrame) -> DataFrame:
    """A row for each item that a conflicting code may mean, in the index's order."""
    many = found.where(F.col("m").isNotNull()).select("*", F.posexplode("m").alias("choice", "__choice"))
    return many.join(items.select(F.struct(*items.columns).alias("item"), F.col("item_id").alias("__item")), F.col("__choice") == F.col("__item"), "left").drop("__item").withColumnRenamed("__choice", "item_id")


def cards(hit: DataFrame) -> DataFrame:
    """The fields of an item card for rows of hits(): columns to show, no markup."""
    it, case = F.col("item"), F.col("case_item")
    return hit.select(
        *(c for c in hit.columns if c not in ("item", "case_item")),
        texts.clean_leaf(it["leaf"]).alias("title"),
        it["name"].alias("path"),
        texts.layer_label(it["layer"]).alias("layer_label"),
        texts.badge(it["rank"]).alias("badge"),
        texts.price_label(it["layer"]).alias("price_label"),
        texts.price_text(it["price"]).alias("price_text"),
        F.when(case.isNotNull(), texts.PRICE_LABELS["c"]).alias("case_price_label"),
        F.when(case.isNotNull(), texts.price_text(case["price"])).alias("case_price_text"),
        F.nullif(it["desc"], F.lit("")).alias("description"),
    )
