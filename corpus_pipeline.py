"""A training-data pipeline: quality classifier, n-gram Jaccard join, substring dedup, secret scans, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet and read
again as the next one's docs. All but the last return the columns of documents. n_chars follows the text.

Defined results, of all stages unless one says otherwise: a null or empty text is a text without words, very long texts are
taken whole, rows with a null id stay (and are packed), an empty table gives no rows, and further columns of any name are kept
up to the last stage, which returns pieces. Of equal texts with ids the one of the smallest id stays; rows that repeat
an id are one document there; rows without an id are never taken for copies, but their repeated passages are cut.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanweft.llm import jaccard_join, packing, quality_classifier, secret_scan, substring_dedup
from scanweft.llm.shared import shared_dir, table


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars of the text as it now is."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier rejects; host is the source, path the language."""
    return quality_classifier.filtered(docs, table(spark, sf_dir, "labels"), F.col("source"), F.col("lang"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group linked by a Jaccard similarity of 0.8 of five-word shingles."""
    return jaccard_join.deduplicated(docs, jaccard_join.Rule(5, 80, 100))


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts every word in a 35-word window that starts elsewhere too."""
    return _counted(substring_dedup.deduplicated(docs))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces the secrets that patterns and the assignment lexer find."""
    return _counted(secret_scan.redact(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents into windows of 2048 tokens at the mixture of their sources."""
    return packing.pack(packing.encode_queues(docs, public_tokenizers.path("byte_bpe_50k.json")))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality),
    ("ngram_jaccard_join", near_duplicates),
    ("substring_dedup", substrings),
    ("secret_scans", secrets),
    ("packing", packed),
]

#: Training a classifier and following links aren't expressible in one SQL query; tests hold stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
