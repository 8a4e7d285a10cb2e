import re
from collections import Counter

import numpy as np

from scanweft.llm import quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    hit = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def test_base_counts_equal_brute_force(docs, rows):
    got = sorted((r.doc_id is None, r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_rules.judged(docs).collect())
    want = sorted((d is None, d, *b, b[0] < 20 or 100 * b[4] > 30 * b[0]) for d, b in ((r[0], base(r[1])) for r in rows))
    assert got == want


def test_repeated_lines_and_windows(spark):
    block = "one two three four five six seven eight nine ten"
    texts = [f"{block}\nother line\n{block}\nother line\n\n \n{block} eleven", "# a | b <c> 50% $x &y *z", block * 2]
    got = {r.doc_id: r for r in quality_rules.judged(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        assert (got[i].n_words, got[i].word_chars, got[i].n_symbols, got[i].n_dup_lines, got[i].n_repeat_words) == base(t)


def test_empty(empty):
    assert quality_rules.judged(empty).count() == 0


def test_model_recovers_accuracies():
    rng = np.random.default_rng(1)
    good = rng.random(20000) < 0.7
    right = np.array([0.9, 0.8, 0.75, 0.95, 0.7])
    votes = np.where(rng.random((20000, 5)) < right, 1, -1) * np.where(good, 1, -1)[:, None] * (rng.random((20000, 5)) < 0.8)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = quality_rules.VoteModel(patterns, counts.astype(float))
    assert abs(model.prior - 0.7) < 0.03
    assert np.abs(model.accuracy() - right).max() < 0.04
    assert np.mean((model.posterior(votes) >= 0.5) == good) > 0.93


def test_clean_documents_stay(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality_rules.judged(docs).where("not base_failed").select("doc_id", "kept").join(labels, "doc_id").collect()
    kept = {q: np.mean([r.kept for r in rows if r.quality == q]) for q in (0, 1)}
    assert kept[1] > 0.97 and kept[0] < 0.5
