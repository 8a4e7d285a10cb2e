"""The scan gate: which reads of a device count.

A read is dropped within COOLDOWN_MS of the last accepted read if it has the same text. An unknown code
counts only as the second of two equal reads within CONFIRM_MS. Dropped reads change nothing but the
pending code.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COOLDOWN_MS, CONFIRM_MS = 3000, 1500


@dataclass
class State:
    last_code: str = ""
    last_at: int = 0
    pending_code: str = ""
    pending_at: int = 0

    def accepts(self, t: int, code: str, known: bool) -> bool:
        """Whether a read counts; takes it into the state."""
        if code == self.last_code and t - self.last_at < COOLDOWN_MS:
            return False
        confirmed = code == self.pending_code and t - self.pending_at < CONFIRM_MS
        if not known and not confirmed:
            self.pending_code, self.pending_at = code, t
            return False
        self.last_code, self.last_at, self.pending_code = code, t, ""
        return True


#: Milliseconds of a device's reads that one window looks through for pauses.
SPAN_MS = 600_000
#: Reads of a stretch up to which it is folded by built-in functions, which hold it; a longer one streams through Python.
FOLDED = 1000


def _stretches(reads: DataFrame) -> DataFrame:
    """reads with the stretch of each: where its span of time began, and its number there.

    Pauses are looked for in spans of time, so that a device with very many reads is many groups; one row of each
    span tells whether it goes on with the stretch before it.
    """
    spanned = reads.withColumn("span", F.floor(F.col("t_ms") / SPAN_MS))
    w = Window.partitionBy("device_id", "span").orderBy("t_ms", "seq")
    pause = F.coalesce(F.col("t_ms") - F.lag("t_ms").over(w) >= COOLDOWN_MS, F.lit(False))
    spanned = spanned.withColumn("pause", pause.cast("long")).withColumn("number", F.sum("pause").over(w)).drop("pause")
    ends = spanned.groupBy("device_id", "span").agg(F.min("t_ms").alias("first"), F.max("t_ms").alias("last"), F.max("number").alias("number"))
    before = Window.partitionBy("device_id").orderBy("span")
    fresh = F.coalesce(F.col("first") - F.lag("last").over(before) >= COOLDOWN_MS, F.lit(True))
    ends = ends.withColumn("fresh", fresh)
    tail = F.when(F.col("number") > 0, F.struct(F.col("span").alias("at"), F.col("number").alias("n"))).when(F.col("fresh"), F.struct(F.col("span").alias("at"), F.lit(0).cast("long").alias("n")))
    ends = ends.withColumn("tail", tail)
    carried = F.last("tail", ignorenulls=True).over(before.rowsBetween(Window.unboundedPreceding, -1))
    head = F.when(F.col("fresh"), F.struct(F.col("span").alias("at"), F.lit(0).cast("long").alias("n"))).otherwise(carried)
    ends = ends.select(F.col("device_id").alias("d"), F.col("span").alias("s"), head.alias("head"))
    joined = spanned.join(ends, F.col("device_id").eqNullSafe(F.col("d")) & (F.col("span") == F.col("s")))
    stretch = F.when(F.col("number") == 0, F.col("head")).otherwise(F.struct(F.col("span").alias("at"), F.col("number").alias("n")))
    return joined.select(*reads.columns, stretch["at"].alias("at"), stretch["n"].alias("n"))


def _fold(reads: Column) -> Column:
    """Those of an ordered array of reads that count."""
    kept = "array<struct<t_ms:bigint,seq:bigint,code:string,known:boolean>>"
    start = F.struct(F.lit("").alias("last_code"), F.lit(0).cast("long").alias("last_at"), F.lit("").alias("pending_code"), F.lit(0).cast("long").alias("pending_at"), F.array().cast(kept).alias("out"))

    def step(s: Column, x: Column) -> Column:
        cooling = (x["code"] == s["last_code"]) & (x["t_ms"] - s["last_at"] < COOLDOWN_MS)
        sure = x["known"] | ((x["code"] == s["pending_code"]) & (x["t_ms"] - s["pending_at"] < CONFIRM_MS))
        take, wait = ~cooling & sure, ~cooling & ~sure
        return F.struct(
            F.when(take, x["code"]).otherwise(s["last_code"]).alias("last_code"),
            F.when(take, x["t_ms"]).otherwise(s["last_at"]).alias("last_at"),
            F.when(take, "").when(wait, x["code"]).otherwise(s["pending_code"]).alias("pending_code"),
            F.when(wait, x["t_ms"]).otherwise(s["pending_at"]).alias("pending_at"),
            F.when(take, F.concat(s["out"], F.array(x))).otherwise(s["out"]).alias("out"),
        )

    return F.aggregate(reads, start, step, lambda s: s["out"])


def accepted(scans: DataFrame) -> DataFrame:
    """The reads that count, of (device_id, seq, t_ms, code, known); ties of time go by seq.

    After a pause of COOLDOWN_MS nothing of a device's past can matter, so its reads fall into stretches that
    are independent of each other. A stretch is folded by built-in functions; one of more than FOLDED reads
    streams through a task in order of time, so that none is held whole. A null code reads as ''.
    """
    plain = scans.select("device_id", "seq", "t_ms", F.coalesce("code", F.lit("")).alias("code"), F.coalesce("known", F.lit(False)).alias("known"))
    reads = _stretches(plain)
    stretch = ["device_id", "at", "n"]
    long = reads.groupBy(*stretch).count().where(F.col("count") > FOLDED).select(*(F.col(c).alias(f"of_{c}") for c in stretch))
    same = F.col("device_id").eqNullSafe(F.col("of_device_id")) & (F.col("at") == F.col("of_at")) & (F.col("n") == F.col("of_n"))
    folded = reads.join(long, same, "left_anti").groupBy(*stretch).agg(F.array_sort(F.collect_list(F.struct("t_ms", "seq", "code", "known"))).alias("reads"))  # FOLDED at most
    folded = folded.select("device_id", F.explode(_fold(F.col("reads"))).alias("x")).select("device_id", "x.seq", "x.t_ms", "x.code", "x.known")
    ordered = reads.join(long, same, "left_semi").repartition(*stretch).sortWithinPartitions(*stretch, "t_ms", "seq")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = None, State()
        for batch in batches:
            keep = []
            for device, span, n, t, code, known in zip(batch["device_id"], batch["at"], batch["n"], batch["t_ms"], batch["code"], batch["known"], strict=True):
                if at != (device, span, n):
                    at, state = (device, span, n), State()
                keep.append(state.accepts(t, code, known))
            yield batch.loc[keep, ["device_id", "seq", "t_ms", "code", "known"]]

    return folded.union(ordered.mapInPandas(run, "device_id long, seq long, t_ms long, code string, known boolean"))
