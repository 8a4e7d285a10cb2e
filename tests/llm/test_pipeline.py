import re
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from scanweft.llm import secret_scan

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


def test_stages_on_documents(spark):
    """Every stage against a plain version of itself on its own input."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    held = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        path = f"{spark.conf.get('spark.checkpoint.dir')}/test-stage-{len(held)}"
        stage(spark, held[-1], SF).write.mode("overwrite").parquet(path)
        held.append(spark.read.parquet(path))
        assert held[-1].columns == columns
        assert held[-1].where("n_chars <> length(text)").count() == 0
    tables = [{r.doc_id: r for r in d.collect()} for d in held]
    # quality: what is labelled good stays, junk goes
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert set(tables[1]) <= set(tables[0])
    kept = {q: np.mean([d in tables[1] for d, x in labels.items() if x == q and d in tables[0]]) for q in (0, 1)}
    assert kept[1] > 0.97 and kept[0] < 0.2
    # near duplicates: no two left are alike, and whatever went has something alike before it
    shingles = {}
    for d, r in tables[1].items():
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), r.text))
        shingles[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    alike = {(a, b) for a in shingles for b in shingles if a < b and (i := len(shingles[a] & shingles[b])) and 100 * i >= 80 * len(shingles[a] | shingles[b])}
    group = {d: d for d in shingles}
    while any(group[b] > group[a] or group[a] > group[b] for a, b in alike):
        for a, b in alike:
            group[a] = group[b] = min(group[a], group[b])
    assert set(tables[2]) == {d for d in group if group[d] == d}
    assert all(tables[2][d].text == tables[1][d].text for d in tables[2])
    # substrings: exactly the covered words are gone
    words = {d: WORD.findall(r.text) for d, r in tables[2].items()}
    seen = Counter(tuple(w[i : i + 35]) for w in words.values() for i in range(len(w) - 34))
    for d, w in words.items():
        gone = {j for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        assert WORD.findall(tables[3][d].text) == [x for j, x in enumerate(w) if j not in gone]
        if not gone:
            assert tables[3][d].text == tables[2][d].text
    # secrets: none of the base kinds is left
    assert set(tables[4]) == set(tables[3])
    assert any(secret_scan.base_spans(r.text) for r in tables[3].values())
    assert not any(secret_scan.base_spans(r.text) for r in tables[4].values())
    # packing: every token once, sequences without gaps
    pieces = corpus_pipeline.STAGES[-1][1](spark, held[-1], SF).collect()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokens = {d: len(library.encode(r.text, add_special_tokens=False).ids) + 1 for d, r in tables[4].items()}
    assert Counter({d: n for d, n in tokens.items()}) == sum((Counter({p.doc_id: p.length}) for p in pieces), Counter())
    ends = {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == ends.get(p.sequence_id, 0)
        ends[p.sequence_id] = p.offset + p.length
    assert all(n == 2048 for s, n in ends.items() if s != max(ends))


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_stages_take_empty_and_awkward_documents(spark, docs, empty):
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for table in (plain, empty):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, table, SF)
            assert out.columns == table.columns and out.count() <= table.count()
    assert corpus_pipeline.STAGES[-1][1](spark, empty, SF).count() == 0
