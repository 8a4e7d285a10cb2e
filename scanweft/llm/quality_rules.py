"""Quality rules by weak supervision (operator 2).

Rules vote 1 (good), -1 (bad) or 0 (abstain) on counts over the whole text. All rows of equal votes are
alike to the model, so one grouped count per vote pattern (at most 3 to the power of the rules) is all
that expectation-maximisation needs: it estimates, without labels, how accurate each rule is on good and
on bad documents, and the share of good ones, over every row. Each pattern then has one posterior,
which a broadcast of that bounded table puts on the rows. Nothing else is shuffled.

Defined results: a null text has no words, so the base rules fail it; an empty table gives no rows;
repeated rows each get their result; null ids stay; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanweft.llm.shared import arrow_rows, buffer_of, steps, stored, texts
from scanweft.llm.text_features import COUNTS, features

_COUNTED = {"doc_id": pa.int64(), **dict.fromkeys(COUNTS, pa.int64())}


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the COUNTS of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in steps(batches):
            yield arrow_rows({"doc_id": step.column(0), **features(*buffer_of(step.column(1)))}, _COUNTED)

    return texts(docs, F.col(id_col).cast("long").alias("doc_id"), text=text_col).mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS))


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rules() -> dict[str, Column]:
    """The votes, from the counts of a document."""
    c = F.col
    cased = c("n_upper") + c("n_lower")
    letters = cased + c("n_wide")
    return {
        "length": _vote(c("n_words") >= 100, c("n_words") < 25),
        "word_length": _vote((c("word_chars") >= 3 * c("n_words")) & (c("word_chars") <= 9 * c("n_words")), (2 * c("word_chars") < 5 * c("n_words")) | (c("word_chars") > 13 * c("n_words"))),
        "symbols": _vote(50 * c("n_symbols") <= c("n_words"), 10 * c("n_symbols") > c("n_words")),
        "letters": _vote(20 * letters >= 19 * c("word_chars"), 10 * (letters + c("n_digits")) < 9 * c("word_chars")),
        "lines": _vote((c("n_lines") >= 3) & (c("n_dup_lines") == 0), 10 * c("n_dup_lines") > 3 * c("n_lines")),
        "repeats": _vote((c("n_words") >= 100) & (50 * c("n_repeat_words") <= c("n_words")), 5 * c("n_repeat_words") > c("n_words")),
        "capitals": _vote(5 * c("n_upper") <= cased, 5 * c("n_upper") > 2 * cased),
        "exclaims": _vote(50 * c("n_exclaim") <= c("n_words"), 10 * c("n_exclaim") > c("n_words")),
        "stops": _vote(40 * c("n_stops") >= c("n_words"), (c("n_words") >= 200) & (c("n_stops") == 0)),
        "digits": _vote(20 * c("n_digits") <= c("word_chars"), 4 * c("n_digits") > c("word_chars")),
    }


class VoteModel:
    """How often each rule, when it votes, votes good or bad on good and on bad documents, and the share of
    good ones, fitted by expectation-maximisation to counts of vote patterns.

    A rule that abstains says nothing. The first round takes a bad vote for stronger evidence than a good
    one. No rule may end worse than chance: a vote for a side is never rarer on that side than on the other.
    """

    def __init__(self, votes: np.ndarray, counts: np.ndarray, rounds: int = 200):
        up, down, total = votes == 1, votes == -1, counts.sum()
        overall = (counts @ up + 1) / (counts @ (up | down) + 2)
        good = 1 / (1 + np.exp(-np.clip(1.5 + 0.3 * up.sum(axis=1) - 2.0 * down.sum(axis=1), -30, 30)))
        self.prior = 0.5
        for _ in range(rounds):
            before = self.prior
            self.prior = float(np.clip((good @ counts + 8) / (total + 10), 0.02, 0.98))
            says = []  # P(votes good | votes, side); ten imagined votes a side are like all votes
            for weight in (good * counts, (1 - good) * counts):
                says.append((weight @ up + 10 * overall) / (weight @ (up | down) + 10))
            worse = says[0] < says[1]
            self.up = {1: np.where(worse, overall, says[0]), -1: np.where(worse, overall, says[1])}
            good = self.posterior(votes)
            if abs(before - self.prior) < 1e-9:
                break

    def accuracy(self) -> np.ndarray:
        """P(a rule's vote is right | it votes)."""
        return self.prior * self.up[1] + (1 - self.prior) * (1 - self.up[-1])

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """P(good | votes)."""
        odds = np.log(self.prior / (1 - self.prior)) + (votes == 1) @ np.log(self.up[1] / self.up[-1]) + (votes == -1) @ np.log((1 - self.up[1]) / (1 - self.up[-1]))
        return 1 / (1 + np.exp(-np.clip(odds, -60, 60)))


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: its counts, base_failed, quality (the posterior) and kept."""
    votes = rules()
    pattern = F.concat_ws(",", *[v.cast("string") for v in votes.values()])
    rows = stored(counted(docs, id_col, text_col).withColumn("votes", pattern), "rule-votes")
    spark = docs.sparkSession
    patterns = [(r["votes"], r["count"]) for r in rows.groupBy("votes").count().orderBy("votes").collect()]  # at most 3 ** 10
    if patterns:
        v = np.array([[int(x) for x in p.split(",")] for p, _ in patterns])
        posterior = VoteModel(v, np.array([c for _, c in patterns], float)).posterior(v)
    else:
        posterior = np.zeros(0)
    quality = spark.createDataFrame([(p, round(float(q), 9)) for (p, _), q in zip(patterns, posterior, strict=True)], "votes string, quality double")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return rows.join(F.broadcast(quality), "votes").withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("quality") >= 0.5))
