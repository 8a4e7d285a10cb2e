"""Quality classifier with hierarchical empirical Bayes (operator 6).

1. A logistic model of counts over the whole text is fitted to a bounded sample of labelled documents (the
   `sample` with the smallest hashes of their ids); its log odds are a document's own evidence.
2. Grouped aggregation over all documents gives each host and each path of a host the sum of its documents'
   probabilities. A host's quality is shrunk toward the global mean, a path's toward its host's, each by a
   strength found by the method of moments from how much groups differ beyond chance: sparse sites
   stay near their prior, large ones speak for themselves.
3. A document's posterior joins both: the log odds of its text, moved by how far its path (without the
   document itself) stands from the global prior.

Sites are aggregated with partial sums before any shuffle, so a host with a third of all rows costs no
more than others; their table is broadcast only if it is small, and joined by shuffle otherwise.

Defined results: a null text is empty; very long texts are counted whole; null ids stay, and are never in the sample;
null hosts and paths are groups of their own; without labels of both kinds the text says nothing and every document
is kept; of an id with two labels the better one counts; an empty table gives no rows; repeated rows each
get their result; other columns, of whatever name, are kept by `filtered` and ignored by `judged`.

`host_of` and `path_of` derive host and path from a URL; a table without URLs gives its source and language.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scanweft.llm.shared import bound_batches, buffer_of, column, plain, steps, stored
from scanweft.llm.text_features import COUNTS, features

#: Labelled documents that the model is fitted to, at most.
SAMPLE = 4096
#: Hosts and paths up to which their table is broadcast (under 200 bytes a row).
BROADCAST_ROWS = 50_000
EVIDENCE = "__evidence"


def host_of(url: Column) -> Column:
    """The host of a URL in small letters, without a leading www. or port; null where there is none."""
    found = F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1)), r"^www\.", "")
    return F.nullif(found, F.lit(""))


def path_of(url: Column, depth: int = 1) -> Column:
    """The first `depth` folders of a URL's path, as /a/b/; the file's name, query and fragment aren't in it."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*)?", 1)
    folders = F.filter(F.split(F.regexp_replace(path, r"[^/]*$", ""), "/"), lambda x: x != "")
    return F.when(host_of(url).isNotNull(), F.concat(F.lit("/"), F.array_join(F.transform(F.slice(folders, 1, depth), lambda x: F.concat(x, F.lit("/"))), "")))


class Model(NamedTuple):
    center: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    def log_odds(self, counts: dict[str, np.ndarray]) -> np.ndarray:
        x = np.clip((ratios(counts) - self.center) / self.scale, -5, 5)
        return np.clip(x @ self.weights + self.bias, -12, 12)


def ratios(c: dict[str, np.ndarray]) -> np.ndarray:
    """What the classifier sees of a text: its counts as ratios, none of which grows with its length but the first."""
    words, chars, lines = (np.maximum(c[k], 1).astype(float) for k in ("n_words", "word_chars", "n_lines"))
    cased = np.maximum(c["n_upper"] + c["n_lower"], 1)
    columns = [np.log1p(c["n_words"]), chars / words, np.sqrt(c["n_symbols"] / words), np.sqrt(c["n_dup_lines"] / lines), np.sqrt(c["n_repeat_words"] / words), np.sqrt(c["n_upper"] / cased), np.sqrt(c["n_exclaim"] / words), np.sqrt(c["n_digits"] / chars), np.sqrt(c["n_stops"] / words), c["n_distinct"] / words, (c["n_upper"] + c["n_lower"] + c["n_wide"]) / chars, (c["n_words"] < 20).astype(float), (c["n_words"] < 5).astype(float)]
    return np.stack(columns, axis=1)


def fit(counts: dict[str, np.ndarray], good: np.ndarray, ridge: float = 1.0) -> Model:
    """Logistic regression by Newton's method; equal rows and labels give equal weights."""
    x = ratios(counts)
    center, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.column_stack([np.clip((x - center) / scale, -5, 5), np.ones(len(x))])
    w = np.zeros(z.shape[1])
    penalty = np.diag([ridge] * (len(w) - 1) + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + penalty, z.T @ (good - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return Model(center, scale, w[:-1], float(w[-1]))


def counted(docs: DataFrame, text_col: str) -> DataFrame:
    """docs with its texts replaced by their COUNTS."""
    bound_batches(docs.sparkSession)
    keep = [f for f in docs.schema.fields if f.name != text_col]
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in steps(batches, text_col):
            counts = features(*buffer_of(step.column(at)))
            yield pa.RecordBatch.from_arrays([c for i, c in enumerate(step.columns) if i != at] + [pa.array(counts[k], pa.int64()) for k in COUNTS], names=[f.name for f in keep] + COUNTS)

    return docs.mapInArrow(run, T.StructType(keep + [T.StructField(k, T.LongType()) for k in COUNTS]))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model | None:
    """The model of a bounded sample of labelled documents, or None if it has not both kinds."""
    labelled = labels.select(column(id_col).alias("__id"), column(label_col).cast("double").alias("__good")).where("__id is not null and __good is not null")
    chosen = labelled.groupBy("__id").agg(F.max("__good").alias("__good")).orderBy(F.xxhash64("__id"), "__id").limit(sample)
    texts = docs.select(column(id_col).alias("__id"), F.coalesce(column(text_col).cast("string"), F.lit("")).alias("text"))
    rows = counted(texts.join(F.broadcast(chosen), "__id"), "text").orderBy("__id").limit(2 * sample).toPandas()  # `sample` ids at most are broadcast
    good = rows["__good"].to_numpy() >= 0.5
    if not 0 < good.sum() < len(good):
        return None
    return fit({k: rows[k].to_numpy() for k in COUNTS}, good.astype(float))


def evidenced(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """docs with the log odds of each text as a further column."""
    bound_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in steps(batches, text_col):
            odds = np.zeros(step.num_rows) if model is None else model.log_odds(features(*buffer_of(step.column(at))))
            yield pa.RecordBatch.from_arrays([*step.columns, pa.array(odds, pa.float64())], names=[*step.schema.names, EVIDENCE])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(EVIDENCE, T.DoubleType())]))


def _strength(n: Column, total: Column, mean: Column | float) -> Column:
    """By the method of moments: how many documents of its own a group needs to weigh as much as its prior."""
    mean = F.lit(mean) if isinstance(mean, float) else mean
    inside = mean * (1 - mean)
    between = (F.sum(n * F.pow(total / n - mean, 2)) - F.sum(inside)) / F.sum(n)
    return F.greatest(F.lit(2.0), F.least(F.lit(1000.0), F.max(inside) / F.greatest(between, F.lit(1e-6)) - 1))


class Sites(NamedTuple):
    paths: DataFrame
    mean: float
    host_strength: float
    path_strength: float
    small: bool


def sites(scored: DataFrame) -> Sites:
    """From rows of host, path and evidence: the prior and the sums of every path, with its host's."""
    p = 1 / (1 + F.exp(-F.col(EVIDENCE)))
    paths = stored(scored.groupBy("__host", "__path").agg(F.count("*").alias("__n"), F.sum(p).alias("__sum")), "quality-sites")
    hosts = paths.groupBy("__host").agg(F.sum("__n").alias("__host_n"), F.sum("__sum").alias("__host_sum"))
    n, total, rows = paths.agg(F.sum("__n"), F.sum("__sum"), F.count("*")).first()
    mean = float(np.clip((total or 0.5) / (n or 1), 0.01, 0.99))
    host_strength = float(hosts.agg(_strength(F.col("__host_n"), F.col("__host_sum"), mean)).first()[0] or 1000.0)
    shrunk = (F.col("__host_sum") + host_strength * mean) / (F.col("__host_n") + host_strength)
    h = hosts.select(F.col("__host").alias("__h_host"), "__host_n", "__host_sum", shrunk.alias("__host_mean"))
    joined = paths.join(h, F.col("__h_host").eqNullSafe(F.col("__host"))).drop("__h_host")
    path_strength = float(joined.agg(_strength(F.col("__n"), F.col("__sum"), F.col("__host_mean"))).first()[0] or 1000.0)
    return Sites(joined, mean, host_strength, path_strength, rows <= BROADCAST_ROWS)


def with_posterior(scored: DataFrame, s: Sites) -> DataFrame:
    """scored with __host_mean, __path_mean (both without the document itself) and __posterior."""
    table = s.paths.withColumnsRenamed({"__host": "__s_host", "__path": "__s_path"}).drop("__host_mean")
    if s.small:
        table = F.broadcast(table)
    joined = scored.join(table, F.col("__host").eqNullSafe(F.col("__s_host")) & F.col("__path").eqNullSafe(F.col("__s_path")))
    own = 1 / (1 + F.exp(-F.col(EVIDENCE)))
    host = (F.col("__host_sum") - own + s.host_strength * s.mean) / (F.col("__host_n") - 1 + s.host_strength)
    path = (F.col("__sum") - own + s.path_strength * F.col("__host_mean")) / (F.col("__n") - 1 + s.path_strength)
    path = F.greatest(F.lit(0.01), F.least(F.lit(0.99), path))
    odds = F.col(EVIDENCE) + F.log(path / (1 - path)) - F.lit(float(np.log(s.mean / (1 - s.mean))))
    return joined.withColumn("__host_mean", host).withColumn("__path_mean", path).withColumn("__posterior", 1 / (1 + F.exp(-odds))).drop("__s_host", "__s_path")


def judged(docs: DataFrame, labels: DataFrame, host: Column, path: Column, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """Per document: the log odds of its text, the means of host and path, the posterior, and whether it is kept."""
    model = train(docs, labels, sample, id_col, text_col)
    rows = docs.select(column(id_col).cast("long").alias("doc_id"), host.cast("string").alias("__host"), path.cast("string").alias("__path"), column(text_col).cast("string").alias("text"))
    scored = stored(evidenced(rows, model).drop("text"), "quality-evidence")
    out = with_posterior(scored, sites(scored))
    return out.select("doc_id", F.col("__host").alias("host"), F.col("__path").alias("path"), F.col(EVIDENCE).alias("evidence"), F.col("__host_mean").alias("host_mean"), F.col("__path_mean").alias("path_mean"), F.col("__posterior").alias("posterior"), (F.col("__posterior") >= threshold).alias("kept"))


def filtered(docs: DataFrame, labels: DataFrame, host: Column, path: Column, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """The documents that are kept, with all their columns. Texts are scored twice, so that none is ever shuffled."""
    model = train(docs, labels, sample, id_col, text_col)
    rows, (own_text,) = plain(docs, text_col)
    named = docs.select(*map(column, docs.columns), host.cast("string"), path.cast("string")).toDF(*rows.columns, "__host", "__path")
    sums = evidenced(named.select("__host", "__path", own_text), model, own_text).drop(own_text)
    return with_posterior(evidenced(named, model, own_text), sites(sums)).where(F.col("__posterior") >= threshold).select(rows.columns).toDF(*docs.columns)
