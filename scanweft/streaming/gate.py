"""The scan gate on a stream of reads, and the bounded history that it feeds."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from scanweft.operators import history
from scanweft.operators.gate import State

_STATE = "last_code string, last_at long, pending_code string, pending_at long, latest long, late long"
ACCEPTED = "device_id long, seq long, t_ms long, code string, known boolean, late long"


def accepted(scans: DataFrame) -> DataFrame:
    """The reads that count, as operators.gate.accepted has them, of a stream of reads per device.

    A device's state is a few values. Reads older than the device's latest are dropped; late is how many
    of them the device has had so far.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        *values, latest, late = held.get if held.exists else ("", 0, "", 0, None, 0)
        state = State(*values)
        reads = pd.concat(list(batches)).sort_values(["t_ms", "seq"], kind="stable")  # one micro-batch of one device
        keep, lates = [], []
        for t, code, known in zip(reads["t_ms"], reads["code"], reads["known"], strict=True):
            if latest is not None and t < latest:
                late += 1
                keep.append(False)
            else:
                latest = int(t)
                keep.append(state.accepts(int(t), code or "", bool(known)))
            lates.append(late)
        held.update((state.last_code, state.last_at, state.pending_code, state.pending_at, latest, late))
        out = reads.assign(late=lates).loc[keep]
        yield out[["device_id", "seq", "t_ms", "code", "known", "late"]]

    plain = scans.select("device_id", "seq", "t_ms", "code", "known")
    return plain.groupBy("device_id").applyInPandasWithState(run, ACCEPTED, _STATE, "append", GroupStateTimeout.NoTimeout)


def keep_history(entries: DataFrame, path: str, checkpoint: str, limit: int = history.LIMIT):
    """A writer that keeps the newest entries of each device in path, a new version each micro-batch.

    A version is written whole before any reader looks at it, and the same batch written again gives the
    same version, so a retried batch does no harm.
    """
    columns = ["device_id", "seq", "code", "status", "item_id", "t_ms"]

    def merge(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        new = batch.select(columns)
        before = latest_history(spark, path, epoch)
        whole = new if before is None else before.select(columns).union(new).dropDuplicates(["device_id", "seq"])
        history.recent(whole, limit).write.mode("overwrite").parquet(f"{path}/version={epoch}")

    return entries.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)


def latest_history(spark, path: str, before: int | None = None) -> DataFrame | None:
    """The newest complete version in path (older than `before`), or None."""
    base = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(base):
        return None
    done = [int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(base) if s.getPath().getName().startswith("version=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    done = [v for v in done if before is None or v < before]
    return spark.read.parquet(f"{path}/version={max(done)}") if done else None
