"""Token ids in binary files (operator 1).

Documents are range-partitioned by id, so that the files hold them in ascending order without any
single sorted task; each partition encodes its texts and packs the ids with Simple-8b. Spark's own
writer commits the files, so a retried or doubled task never leaves a partial one, and any store that
Spark writes to will do. One row of a file is a segment: its partition, the ids before it in that
partition, the documents' ids and lengths, and the payload of simple8b. One total per partition is
all that the driver sees.

Defined results: a null text is empty and yields only the end id; null document ids come first; rows that
repeat an id are kept, in order of their texts; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanweft.llm import simple8b
from scanweft.llm.encoding import encoder
from scanweft.llm.shared import arrow_rows, shared_dir, steps, texts

SEGMENT = "part int, seq int, start long, doc_ids array<long>, lengths array<int>, payload binary"
_SEGMENT = {"part": pa.int32(), "seq": pa.int32(), "start": pa.int64(), "doc_ids": pa.list_(pa.int64()), "lengths": pa.list_(pa.int32()), "payload": pa.binary()}
DIGEST = "doc_id long, start long, n_tokens long, ids_crc32 long"
_DIGEST = {"doc_id": pa.int64(), "start": pa.int64(), "n_tokens": pa.int64(), "ids_crc32": pa.int64()}


def write_tokens(docs: DataFrame, tokenizer: str, path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the ids of every text of docs, each with end_id after it, in ascending order of id_col."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end, part, start = encoder(tokenizer).encode, np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId(), 0
        for seq, step in enumerate(steps(batches)):
            ids = [x + end for x in encode(step.column(1).to_pylist())]
            flat = np.frombuffer(b"".join(ids), "<u4")
            yield arrow_rows({"part": [part], "seq": [seq], "start": [start], "doc_ids": [step.column(0).to_pylist()], "lengths": [[len(x) // 4 for x in ids]], "payload": [simple8b.pack(flat)]}, _SEGMENT)
            start += len(flat)

    named = texts(docs, F.col(id_col).cast("long").alias("doc_id"), text=text_col)
    named.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(pack, SEGMENT).write.parquet(path)


def bases(segments: DataFrame) -> dict[int, int]:
    """Ids before each partition; one number per written partition."""
    total, out = 0, {}
    for r in segments.groupBy("part").agg(F.max("start").alias("start"), F.max_by(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x), "seq").alias("last")).orderBy("part").collect():
        out[r["part"]] = total
        total += r["start"] + r["last"]
    return out


def read_tokens(spark: SparkSession, path: str, schema: str, each) -> DataFrame:
    """A row batch for each segment of the files: each(doc_ids, lengths, ids, start)."""
    segments = spark.read.schema(SEGMENT).parquet(path)
    before = bases(segments)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part, _, start, ids, lengths, payload = (c[i] for c in batch.columns)
                yield each(ids.as_py(), np.array(lengths.as_py(), np.int64), simple8b.unpack(payload.as_buffer().to_pybytes()).astype("<u4"), before[part.as_py()] + start.as_py())

    return segments.mapInArrow(unpack, schema)


def _digest(doc_ids: list, lengths: np.ndarray, ids: np.ndarray, start: int) -> pa.RecordBatch:
    ends = np.cumsum(lengths)
    raw = memoryview(ids.tobytes())
    crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
    return arrow_rows({"doc_id": doc_ids, "start": start + ends - lengths, "n_tokens": lengths, "ids_crc32": crc}, _DIGEST)


def read_digest(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32."""
    return read_tokens(spark, path, DIGEST, _digest)


def tokens_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
