import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from scanweft.llm import packing

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def check(rows, pieces, window):
    library = Tokenizer.from_file(TOKENIZER)
    want = Counter()
    for doc_id, text, *_ in rows:
        want[doc_id, len(library.encode(text or "", add_special_tokens=False).ids) + 1] += 1
    got, by = Counter(), defaultdict(list)
    for p in pieces:
        by[p.doc_id].append(p)
        got[p.doc_id] += p.length
    total = Counter()
    for (d, n), times in want.items():
        total[d] += n * times
    assert got == total
    ends = Counter()
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == ends[p.sequence_id] and 0 < p.length <= window
        ends[p.sequence_id] += p.length
    assert all(n == window for s, n in ends.items() if s != max(ends))
    assert set(ends) == set(range(len(ends)))
    texts = {d: t for d, t, *_ in rows}
    for d, own in by.items():
        if sum(k[0] == d for k in want.elements()) == 1:
            ids = np.array([*library.encode(texts[d] or "", add_special_tokens=False).ids, 1], "<u4")
            at = 0
            for p in sorted(own, key=lambda p: p.start):
                assert (p.start, p.doc_tokens) == (at, len(ids)) and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
                at += p.length


@pytest.mark.parametrize("window", [2048, 64, 32])
def test_every_token_once(docs, rows, window):
    check(rows, packing.pack(packing.encode_queues(docs, TOKENIZER), window).collect(), window)


def test_special_tokens_of_texts(spark):
    rows = [(0, "see <|endoftext|> here", "a"), (1, "<|endoftext|><|endoftext|>", "b"), (2, "none", "a")]
    pieces = packing.pack(packing.encode_queues(spark.createDataFrame(rows, "doc_id long, text string, source string"), TOKENIZER)).collect()
    plain = Tokenizer.from_file(TOKENIZER)
    want = {d: [*plain.encode(t, add_special_tokens=False).ids, 1] for d, t, _ in rows}
    assert {p.doc_id: (p.length, p.ids_crc32) for p in pieces} == {d: (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for d, ids in want.items()}


def test_empty(empty):
    assert packing.pack(packing.encode_queues(empty, TOKENIZER)).count() == 0


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_every_window_has_the_mixture(spark):
    rows = [(i, "some words in a row " * (1 + i % 37), f"s{min(i % 25, 19)}") for i in range(1800)]
    pieces = packing.pack(packing.encode_queues(table(spark, rows), TOKENIZER)).collect()
    check(rows, pieces, 2048)
    total, windows = Counter(), defaultdict(Counter)
    for p in pieces:
        total[p.source] += p.length
        windows[p.sequence_id][p.source] += p.length
    assert len(total) == 20 and len(windows) > 50
    all_ = sum(total.values())
    carried = Counter()
    for w in sorted(windows)[:-2]:
        for s in total:
            assert abs(windows[w][s] - 2048 * total[s] / all_) <= 2  # of 2048
            carried[s] += windows[w][s] - 2048 * total[s] / all_
            assert abs(carried[s]) <= 2  # deficits are carried, never lost


def test_many_small_sources_share_a_queue(spark):
    rows = [(i, "some words in a row " * (1 + i % 7), f"host{i}") for i in range(700)] + [(1000 + i, "more words " * 30, "large") for i in range(300)]
    pieces = packing.pack(packing.encode_queues(table(spark, rows), TOKENIZER), 64).collect()
    check(rows, pieces, 64)
    windows = defaultdict(Counter)
    for p in pieces:
        windows[p.sequence_id][p.source == "large"] += p.length
    share = sum(w[True] for w in windows.values()) / sum(sum(w.values()) for w in windows.values())
    assert all(abs(windows[w][True] - 64 * share) <= 2 for w in sorted(windows)[:-2])


def test_wide_ids(spark):
    rows = [(1, "some words", "a"), (2, None, "b")]
    pieces = packing.pack(packing.encode_queues(table(spark, rows), TOKENIZER, end_id=70_000)).collect()
    library = Tokenizer.from_file(TOKENIZER)
    assert {p.doc_id: p.ids_crc32 for p in pieces} == {d: zlib.crc32(np.array([*library.encode(t or "").ids, 70_000], "<u4").tobytes()) for d, t, _ in rows}


def test_given_mixture(spark):
    rows = [(i, "some words in a row " * 40, "big" if i % 4 else None) for i in range(400)]
    encoded = packing.encode_queues(spark.createDataFrame(rows, "doc_id long, text string, source string"), TOKENIZER)
    pieces = packing.pack(encoded, mixture={"big": 1.0, None: 1.0}).collect()
    check(rows, pieces, 2048)
    windows = defaultdict(Counter)
    for p in pieces:
        windows[p.sequence_id][p.source] += p.length
    both = [w for w in sorted(windows) if windows[w][None]]
    assert both[: len(both) - 2] == list(range(len(both) - 2))  # the smaller one goes first, half of each window
    assert all(abs(windows[w][None] - 1024) <= 1 for w in both[:-3])
    with pytest.raises(ValueError, match="without"):
        packing.pack(encoded, mixture={"big": 1.0})


def test_phases_take_no_more_than_there_is():
    rng = np.random.default_rng(1)
    for size in (16, 64, 2048):
        for _ in range(60):
            amounts = rng.integers(0, 10 ** int(rng.integers(1, 13)), int(rng.integers(1, size // 2))).astype(np.int64)
            for weights in (None, rng.integers(1, 1000, len(amounts))):
                if weights is not None and len(amounts) > 30:
                    continue
                plan, given, full = packing.phases(amounts, size, weights)
                assert (given <= amounts).all() and given.sum() == full * size == sum(p.windows for p in plan) * size
                if weights is None:
                    assert (amounts - given).sum() <= (4 + len(amounts)) * size
                for p in plan:
                    every = np.arange(len(amounts))
                    for k in rng.integers(0, p.windows, 5):
                        own = p.given(every, np.int64(k + 1), size) - p.given(every, np.int64(k), size)
                        assert own.sum() == size and (own >= 0).all()
                        assert (np.abs(own - size * (p.bounds[1] - p.bounds[0]) / packing.WHOLE) <= 2).all()


def test_due_is_exact():
    rng = np.random.default_rng(2)
    for tokens, bound in zip(rng.integers(0, 1 << 50, 300).tolist(), rng.integers(0, (1 << 32) + 1, 300).tolist(), strict=True):
        assert int(packing.due(np.int64(bound), np.int64(tokens))) == tokens * bound >> 32
