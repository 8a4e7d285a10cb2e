"""Counts over whole texts that the quality operators share, vectorised over a buffer of many texts.

Equal lines and windows are found by 64-bit hashes within one text, where a chance collision of n of
them has a probability of about n*n / 2**65. The hashes' numbers are fixed, so texts made against them on purpose
could still collide.
"""

from __future__ import annotations

import numpy as np

from scanweft.llm.shared import SPACE, counts_by, gram_hash, mix, span_hash, words_of

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower", "n_digits", "n_exclaim", "n_stops", "n_wide", "n_distinct"]
_KINDS = ["other", "space", "inner", "symbol", "upper", "lower", "digit", "exclaim", "stop", "wide"]
_KIND = np.zeros(256, np.int64)
_KIND[SPACE] = 1
_KIND[0x80:0xC0] = 2  # further bytes of a character
_KIND[list(b"#*$%&|<>")] = 3
_KIND[ord("A") : ord("Z") + 1] = 4
_KIND[ord("a") : ord("z") + 1] = 5
_KIND[ord("0") : ord("9") + 1] = 6
_KIND[ord("!")] = 7
_KIND[list(b".?;:")] = 8
_KIND[0xC0:] = 9


def _equal(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stable order of keys, and whether each in that order equals the one before."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    same = np.zeros(len(keys), bool)
    same[1:] = ordered[1:] == ordered[:-1]
    return order, same


def repeated_words(words: np.ndarray, row: np.ndarray, n: int, k: int) -> np.ndarray:
    """Per row, the words in k-word windows that the row holds twice or more."""
    if len(words) < k:
        return np.zeros(n, np.int64)
    at = np.flatnonzero(row[k - 1 :] == row[: len(row) - k + 1])
    order, same = _equal(mix(gram_hash(words, k)[at] + row[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    twice = same.copy()
    twice[:-1] |= same[1:]
    hit = at[order[twice]]
    depth = np.zeros(len(words) + 1, np.int64)
    np.add.at(depth, hit, 1)
    np.add.at(depth, hit + k, -1)
    return counts_by(row[np.cumsum(depth[:-1]) > 0], n)


def features(raw: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The COUNTS of each text."""
    n = len(offsets) - 1
    starts, ends, row = words_of(raw, offsets)
    kinds = np.bincount(np.repeat(np.arange(n) * len(_KINDS), np.diff(offsets)) + _KIND[raw], minlength=n * len(_KINDS)).reshape(n, len(_KINDS))
    of = {k: kinds[:, i] for i, k in enumerate(_KINDS)}
    words = span_hash(raw, starts, ends)
    # lines: ended by a line feed or by the text
    feeds = np.flatnonzero(raw == 10)
    line_ends, line_starts = np.sort(np.concatenate([feeds, offsets[1:]])), np.sort(np.concatenate([feeds + 1, offsets[:-1]]))
    line_row = np.repeat(np.arange(n), 1 + counts_by(np.searchsorted(offsets, feeds, side="right") - 1, n))
    before = np.searchsorted(starts, line_starts)
    real = (np.searchsorted(starts, line_ends) > before) & (line_ends > line_starts)
    lines = span_hash(raw, line_starts[real], line_ends[real])
    real_row = line_row[real]
    order, same = _equal(mix(lines + real_row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    word_order, word_same = _equal(mix(words + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    return {
        "n_words": counts_by(row, n),
        "word_chars": kinds.sum(axis=1) - of["space"] - of["inner"],
        "n_symbols": of["symbol"],
        "n_dup_lines": counts_by(real_row[order[same]], n),
        "n_repeat_words": repeated_words(words, row, n, 8),
        "n_lines": counts_by(real_row, n),
        "n_upper": of["upper"],
        "n_lower": of["lower"],
        "n_digits": of["digit"],
        "n_exclaim": of["exclaim"],
        "n_stops": of["stop"],
        "n_wide": of["wide"],
        "n_distinct": counts_by(row[word_order[~word_same]], n),
    }
