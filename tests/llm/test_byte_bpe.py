import base64
import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from scanweft.llm import byte_bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_round_trip_equals_the_library(docs, rows, library):
    got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in byte_bpe.round_trip(docs, PATH, public_tokenizers.PATTERN).collect())
    want = []
    for doc_id, text, *_ in rows:
        ids = library.encode_ordinary(text or "")
        want.append((str(doc_id), len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(want)


def test_matches_of_every_length(library):
    own = byte_bpe.codec(PATH, public_tokenizers.PATTERN)
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(list("abcé 珍-1"), n)) for n in (1, 2, 3, 7, 40, 300)]
    texts += ["ab" * n for n in (1, 5, 511, 512, 513, 3000)] + ["a" * 5000, "   " * 700, "\n" * 90, "<|endoftext|>", "𝒳" * 600]
    for t, (ids, decimal) in zip(texts, own.encode(texts), strict=True):
        assert ids.tolist() == library.encode_ordinary(t) and decimal == ",".join(map(str, ids.tolist()))
        assert own.decode(ids) == t.encode()


def test_heap_and_matrix_agree():
    own = byte_bpe.codec(PATH, public_tokenizers.PATTERN)
    for t in ("internationalisation", "aaaaaaaaaaaaaaaaaaaaaaaaaaaa", "über" * 20):
        assert own.merge_long(t.encode()).tolist() == own.encode_matches([t])[0].tolist()


def test_ids_column_and_empty(docs, empty):
    assert byte_bpe.encoded(docs, PATH, public_tokenizers.PATTERN).count() == docs.count()
    assert byte_bpe.round_trip(empty, PATH, public_tokenizers.PATTERN).count() == 0
