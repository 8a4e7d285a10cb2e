"""Byte-level BPE encoding and decoding by ranks (operator 8), over padded numpy matrices.

Every distinct match of the pattern is a row of bytes; rows of like length share a matrix. In each round
every row merges its leftmost pair of minimum rank, so all rows shorten by one, and rows without a
mergeable pair leave the matrix. Pairs are found in an open-addressed hash table of (left, right) -> merged.
A match of over LONGEST bytes takes the same merges from a heap, as rounds over it would cost its square.
A worker encodes a match once and remembers it.

Defined results: a null text is empty and has no ids; an empty table gives no rows; repeated rows each get
their result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanweft.llm.shared import arrow_rows, mix, steps, texts

LONGEST = 1024
#: Matches that a worker remembers; beyond, it forgets all and starts again.
REMEMBERED = 400_000
NONE = np.int32(2**31 - 1)
DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
_DIGEST = {"doc_id": pa.int64(), "n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
_codecs: dict[tuple[str, str], Codec] = {}


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern = regex.compile(pattern)
        self.ranks = ranks
        self.pieces: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for piece, rank in ranks.items():
            self.pieces[rank] = piece
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = {(ranks[p[:i]], ranks[p[i:]]): r for p, r in ranks.items() for i in range(1, len(p)) if p[:i] in ranks and p[i:] in ranks}
        self.bits = max(4, int(np.ceil(np.log2(4 * max(1, len(pairs))))))
        self.keys, self.merged = np.full((1 << self.bits) + 64, -1, np.int64), np.full((1 << self.bits) + 64, NONE, np.int32)
        keys = np.array([(a << 32) | b for a, b in pairs], np.int64)
        self.probes = 1
        for key, at, rank in zip(keys.tolist(), self._slot(keys).tolist(), pairs.values(), strict=True):
            step = 0
            while self.keys[at + step] >= 0:
                step += 1
            self.keys[at + step], self.merged[at + step] = key, rank
            self.probes = max(self.probes, step + 1)
        self.known: dict[str, tuple[bytes, str]] = {}

    @classmethod
    def load(cls, path: str, pattern: str) -> Codec:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys.view(np.uint64)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The id that each pair merges into, NONE if it doesn't."""
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        at = self._slot(keys.ravel())
        keys = keys.ravel()
        out = np.where(self.keys[at] == keys, self.merged[at], NONE)
        open_ = np.flatnonzero((out == NONE) & (self.keys[at] >= 0))
        for step in range(1, self.probes):
            if not len(open_):
                break
            there = self.keys[at[open_] + step]
            hit = there == keys[open_]
            out[open_[hit]] = self.merged[at[open_[hit]] + step]
            open_ = open_[~hit & (there >= 0)]
        return out.reshape(left.shape)

    def merge_matrix(self, tokens: np.ndarray, rows: np.ndarray, out: list) -> None:
        """tokens: a row per match of the same length. Puts each row's ids at its place of out."""
        ranks = self.pair_ranks(tokens[:, :-1], tokens[:, 1:])
        while True:
            j = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(rows), np.int64)
            best = ranks[np.arange(len(rows)), j] if ranks.shape[1] else np.full(len(rows), NONE)
            done = best == NONE
            if done.any():
                for r, ids in zip(rows[done].tolist(), tokens[done], strict=True):
                    out[r] = ids
                keep = ~done
                tokens, ranks, rows, j, best = tokens[keep], ranks[keep], rows[keep], j[keep], best[keep]
            if not len(rows):
                return
            here, col = np.arange(len(rows)), np.arange(tokens.shape[1] - 1)
            tokens[here, j] = best
            tokens = np.take_along_axis(tokens, col + (col > j[:, None]), axis=1)
            col = col[:-1]
            ranks = np.take_along_axis(ranks, col + (col >= j[:, None]), axis=1)
            if ranks.shape[1]:
                for side in (-1, 0):
                    k = j + side
                    ok = (k >= 0) & (k < ranks.shape[1])
                    ranks[here[ok], k[ok]] = self.pair_ranks(tokens[here[ok], k[ok]], tokens[here[ok], k[ok] + 1])

    def merge_long(self, raw: bytes) -> np.ndarray:
        """The same merges for one very long match: leftmost minimum first, from a heap."""
        ids = self.single[np.frombuffer(raw, np.uint8)].tolist()
        n, pieces, ranks = len(ids), self.pieces, self.ranks
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            if i >= 0 and (k := after[i]) < n and (r := ranks.get(pieces[ids[i]] + pieces[ids[k]])) is not None:
                heapq.heappush(heap, (r, i, ids[i], ids[k]))

        for i in range(n - 1):
            offer(i)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            k = after[i]
            if ids[i] != a or k >= n or ids[k] != b:
                continue
            ids[i], ids[k], after[i] = r, -1, after[k]
            if after[i] < n:
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return np.array([x for x in ids if x >= 0], np.int32)

    def encode_matches(self, matches: list[str]) -> list[np.ndarray]:
        raw = [m.encode() for m in matches]
        size = np.array([len(x) for x in raw], np.int64)
        out: list = [np.zeros(0, np.int32)] * len(raw)
        for n in np.unique(size).tolist():
            rows = np.flatnonzero(size == n)
            if n > LONGEST:
                for r in rows.tolist():
                    out[r] = self.merge_long(raw[r])
            elif n:
                held = max(1, (8 << 20) // n)
                for at in range(0, len(rows), held):
                    part = rows[at : at + held]
                    self.merge_matrix(self.single[np.frombuffer(b"".join([raw[r] for r in part.tolist()]), np.uint8).reshape(len(part), n)], part, out)
        return out

    def _learn(self, matches: set[str]) -> None:
        new = list(matches.difference(self.known))
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = list(matches)
        for m, ids in zip(new, self.encode_matches(new), strict=True):
            self.known[m] = (ids.astype("<u4").tobytes(), ",".join(map(str, ids.tolist())))

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, str]]:
        """The ids of each text, and the same in decimal joined by commas."""
        found = [self.pattern.findall(t) for t in texts]
        self._learn(set().union(*found))
        for matches in found:
            both = list(map(self.known.__getitem__, matches))
            yield np.frombuffer(b"".join([x for x, _ in both]), "<u4"), ",".join([s for _, s in both])

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids.tolist()))


def codec(path: str, pattern: str) -> Codec:
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec.load(path, pattern)
    return _codecs[path, pattern]


def encoded(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the ids of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks, pattern)
        for step in steps(batches):
            yield pa.RecordBatch.from_arrays([step.column(0), pa.array([x.astype(np.int32) for x, _ in own.encode(step.column(1).to_pylist())], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return texts(docs, F.col(id_col).cast("long").alias("doc_id"), text=text_col).mapInArrow(run, "doc_id long, ids array<int>")


def round_trip(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes every text and decodes the ids: doc_id, n_tokens and both checksums. Nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks, pattern)
        for step in steps(batches):
            n, ids_sha, text_sha = [], [], []
            for ids, decimal in own.encode(step.column(1).to_pylist()):
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(decimal.encode()).hexdigest())
                text_sha.append(hashlib.sha256(own.decode(ids)).hexdigest())
            yield arrow_rows({"doc_id": step.column(0), "n_tokens": n, "ids_sha256": ids_sha, "decoded_sha256": text_sha}, _DIGEST)

    return texts(docs, F.col(id_col).cast("long").alias("doc_id"), text=text_col).mapInArrow(run, DIGEST)
