import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from scanweft.llm import simple8b, token_output
from scanweft.llm.encoding import Encoder, encoder

ODD = ["", " ", "  a", "a  b", "a\nb c\n d", "It's we'll THEY'RE", "x" * 3000, "ÀÉ ß İstanbul ΑΣ ὈΔΥΣΣΕΎΣ", "é ä 가", "a b 　c  d", "12 345\t6", "😀 👩‍👩‍👧 | x|y \n| z", "<|endoftext|> a <|startoftext|>", "\x1c a\x85b ﻿c", "don't  'S 'll", " lead", "trail ", "trail\n"]


@pytest.mark.parametrize(("name", "dtype"), [("word_bpe_49k.json", "<u4"), ("byte_bpe_50k.json", "<u2"), ("byte_bpe_50k.json", "<u4")])
def test_encoder_equals_the_library(rows, name, dtype):
    own = Encoder(public_tokenizers.path(name), dtype)
    plain = Tokenizer.from_file(public_tokenizers.path(name))
    plain.encode_special_tokens = True
    texts = ODD + [r[1] or "" for r in rows]
    for _ in range(2):
        for t, ids in zip(texts, own.encode(texts), strict=True):
            assert np.frombuffer(ids, dtype).tolist() == plain.encode(t, add_special_tokens=False).ids, t[:60]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 50000), st.integers(0, 2**64 - 1), st.integers(2**59, 2**61)), max_size=400), st.sampled_from([1, 7, 64, 1024]))
def test_simple8b_round_trip(ids, block):
    payload = simple8b.pack(np.array(ids, np.uint64), block)
    assert simple8b.unpack(payload).tolist() == ids
    assert simple8b.unpack(payload, 1, 3).tolist() == ids[block : 3 * block]


def test_simple8b_is_dense():
    assert len(simple8b.pack(np.zeros(60 * 1024, np.uint64))) < 60 * 1024 / 50 * 8 + 300
    assert len(simple8b.pack(np.full(4096, 30000, np.uint64))) < 4096 * 2.1


def test_files_equal_brute_force(spark, docs, rows):
    path = token_output.tokens_path(spark)
    token_output.write_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), path)
    got = sorted(map(tuple, token_output.read_digest(spark, path).collect()), key=lambda r: r[1])
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    plain.encode_special_tokens = True
    want, start = [], 0
    for doc_id, text, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want


def test_empty(spark, empty):
    path = token_output.tokens_path(spark)
    token_output.write_tokens(empty, public_tokenizers.path("word_bpe_49k.json"), path)
    assert token_output.read_digest(spark, path).count() == 0


SPECIAL = ["see <|endoftext|> here", "<|endoftext|>", "a<|endoftext|><|startoftext|>b", "x  <|startoftext|> \n É<|endoftext|> ", "<|ENDOFTEXT|> <|endoftext", "no such token, It's 12"]


@pytest.mark.parametrize(("name", "dtype"), [("word_bpe_49k.json", "<u4"), ("byte_bpe_50k.json", "<u2")])
def test_ids_are_those_of_an_unmodified_tokenizer(rows, name, dtype):
    own, plain = encoder(public_tokenizers.path(name), dtype), Tokenizer.from_file(public_tokenizers.path(name))
    texts = SPECIAL + ODD + [r[1] or "" for r in rows]
    for t, ids in zip(texts, own.encode(texts), strict=True):
        assert np.frombuffer(ids, dtype).tolist() == plain.encode(t, add_special_tokens=False).ids, t[:60]


def test_files_hold_special_tokens_of_texts(spark):
    path, name = token_output.tokens_path(spark), public_tokenizers.path("word_bpe_49k.json")
    token_output.write_tokens(spark.createDataFrame(list(enumerate(SPECIAL)), "doc_id long, text string"), name, path)
    want, start, plain = [], 0, Tokenizer.from_file(name)
    for i, text in enumerate(SPECIAL):
        ids = np.array([*plain.encode(text, add_special_tokens=False).ids, 1], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, token_output.read_digest(spark, path).collect())) == want
