"""Simple-8b with escapes and block offsets, encoded and decoded without a Python step per id.

A payload, all little-endian:
    8 bytes   magic b"S8BLOCK1"
    u32 u32   ids in a block, number of blocks
    u64       number of ids
    u32 x (blocks + 1)   first word of each block, then the number of words
    (4 zero bytes if needed, so that words are aligned)
    u64 x words
A word holds a selector in its top 4 bits and up to 60 bits of equally wide fields, the first id lowest.
Selector 0 is the escape: the id is the whole next word. The last word of a block may hold fewer ids
than its selector says. A block decodes alone, so any range of ids is read without what stands before it.
"""

from __future__ import annotations

import numpy as np

MAGIC = b"S8BLOCK1"
BLOCK = 1024
#: Fixed values of the coding: ids in a word and bits of each, by selector from 1 to 14.
FIELDS = [(60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
COUNT = np.array([1, *(c for c, _ in FIELDS)], np.int64)
WIDTH = np.array([64, *(b for _, b in FIELDS)], np.int64)


def _all_of(small: np.ndarray, count: int) -> np.ndarray:
    """Whether each place and the count - 1 after it are small; columns beyond the last count as small."""
    out, size, at = None, 1, 0
    while True:
        if count & size:
            part = small[:, at:]
            out = part if out is None else out[:, : part.shape[1]] & part
            at += size
        size *= 2
        if size > count:
            return out
        small = small[:, : -size // 2] & small[:, size // 2 :]


def _selectors(rows: np.ndarray) -> np.ndarray:
    """For a word that starts at any id: the selector that takes most ids. rows: a block each, filled up with zeros."""
    blocks, block = rows.shape
    best = np.zeros((blocks, block), np.int8)
    most = int(rows.max()) if rows.size else 0
    if most < 1 << 32:
        rows = rows.astype(np.uint32)
    for selector, (count, bits) in reversed(list(enumerate(FIELDS, 1))):
        if most < 1 << bits:
            best[:] = selector
            continue
        small = np.ones((blocks, block + 64), bool)
        small[:, :block] = rows < rows.dtype.type(1 << bits)
        best[_all_of(small, count)[:, :block]] = selector
    return best


def pack(ids: np.ndarray, block: int = BLOCK) -> bytes:
    ids = np.ascontiguousarray(ids, dtype=np.uint64)
    n = len(ids)
    blocks = -(-n // block)
    room = np.minimum(block * (np.arange(n) // block + 1), n) - np.arange(n)
    rows = np.zeros(blocks * block, np.uint64)
    rows[:n] = ids
    selector = _selectors(rows.reshape(blocks, block)).ravel()[:n] if n else np.zeros(0, np.int8)
    at, owner = np.arange(blocks) * block, np.arange(blocks)
    end = np.minimum(at + block, n)
    begun, of = [], []
    while len(at):  # all blocks take their next word at once
        begun.append(at)
        of.append(owner)
        at = at + np.minimum(COUNT[selector[at]], room[at])
        open_ = at < end
        at, end, owner = at[open_], end[open_], owner[open_]
    starts = np.sort(np.concatenate(begun)) if begun else np.zeros(0, np.int64)
    kind = selector[starts].astype(np.int64)
    place = np.cumsum(1 + (kind == 0)) - 1 - (kind == 0)
    words = np.zeros(int(len(starts) + (kind == 0).sum()), np.uint64)
    padded = np.concatenate([ids, np.zeros(int(COUNT.max()), np.uint64)])
    for s in np.unique(kind):
        mine = np.flatnonzero(kind == s)
        if s == 0:
            words[place[mine] + 1] = ids[starts[mine]]
            continue
        j = np.arange(COUNT[s])
        fields = padded[starts[mine][:, None] + j]
        fields[j >= room[starts[mine]][:, None]] = 0
        words[place[mine]] = np.bitwise_or.reduce(fields << (j * WIDTH[s]).astype(np.uint64), axis=1) | (np.uint64(s) << np.uint64(60))
    firsts = place[np.searchsorted(starts, np.arange(blocks) * block)] if blocks else np.zeros(0, np.int64)
    offsets = np.append(firsts, len(words)).astype("<u4")
    head = MAGIC + np.array([block, blocks], "<u4").tobytes() + np.array([n], "<u8").tobytes() + offsets.tobytes()
    return head + b"\0" * (-len(head) % 8) + words.astype("<u8").tobytes()


def unpack(payload: bytes, first_block: int = 0, last_block: int | None = None) -> np.ndarray:
    """The ids of the given blocks (all: the default) as unsigned 64-bit integers."""
    if payload[:8] != MAGIC:
        raise ValueError("not a Simple-8b payload")
    block, blocks = np.frombuffer(payload, "<u4", 2, 8).tolist()
    n = int(np.frombuffer(payload, "<u8", 1, 16)[0])
    offsets = np.frombuffer(payload, "<u4", blocks + 1, 24).astype(np.int64)
    last_block = blocks if last_block is None else min(last_block, blocks)
    if first_block >= last_block:
        return np.zeros(0, np.uint64)
    base = 24 + 4 * (blocks + 1)
    words = np.frombuffer(payload, "<u8", int(offsets[-1]), base + -base % 8)[offsets[first_block] : offsets[last_block]]
    edges = offsets[first_block : last_block + 1] - offsets[first_block]
    kind = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words) + 1, bool)
    raw[np.flatnonzero(kind == 0) + 1] = True  # an escaped id has a bit above the 60th, so it never looks like an escape
    raw = raw[: len(words)]
    counts = np.where(raw, 0, COUNT[np.where(raw, 0, kind)])
    owner = np.searchsorted(edges, np.arange(len(words)), side="right") - 1
    total = np.cumsum(counts)
    before = np.concatenate([[0], total])[edges[owner]]
    inside = total - counts - before
    size = np.minimum(block, n - (first_block + owner) * block)
    counts = np.clip(np.minimum(counts, size - inside), 0, None)
    to = (owner * block + inside).astype(np.int64)
    out = np.zeros(min(n, last_block * block) - first_block * block, np.uint64)
    for s in np.unique(kind[~raw]):
        mine = np.flatnonzero((kind == s) & ~raw)
        if s == 0:
            out[to[mine]] = words[mine + 1]
            continue
        j = np.arange(COUNT[s])
        fields = (words[mine][:, None] >> (j * WIDTH[s]).astype(np.uint64)) & np.uint64((1 << int(WIDTH[s])) - 1)
        real = j < counts[mine][:, None]
        out[(to[mine][:, None] + j)[real]] = fields[real]
    return out
