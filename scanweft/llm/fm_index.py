"""A compressed FM-index over sequences of words, searched backward for many documents at once.

The text is all sequences, each followed by a separator. Suffixes are ordered by their first `window` words,
which is all that patterns of up to that length need: the suffixes that start with a pattern P lie together,
and one word c before P leads to C[c] plus the ranks of c at both ends of P's interval, as no suffix
outside the interval can tie with P. The Burrows-Wheeler transform is a wavelet matrix: a level per bit
of a word's number, each a compressed bit vector. Suffix positions aren't kept: what remains of them is the
number of occurrences before each place and where prefixes of window - 1 words end.
"""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit vector that keeps only the 64-bit words that hold both zeros and ones, as the transform has long runs.

    Per word: a byte (its kind and how many kept words its block of 8 has before it) and the ones before it in its
    block, in 16 bits; per block: the ones and the kept words before it.
    """

    def __init__(self, bit: np.ndarray):
        words = np.packbits(np.concatenate([bit, np.zeros(-len(bit) % 512 + 512, bool)]), bitorder="little").view("<u8")
        ones = np.bitwise_count(words).astype(np.int64).reshape(-1, 8)
        mixed = ((ones != 0) & (ones != 64)).astype(np.int64)
        self.ones = (np.cumsum(ones.sum(axis=1)) - ones.sum(axis=1)).astype(np.uint32)
        self.within = (np.cumsum(ones, axis=1) - ones).astype(np.uint16).ravel()
        self.first = (2 + np.cumsum(mixed.sum(axis=1)) - mixed.sum(axis=1)).astype(np.uint32)
        self.kind = (np.where(mixed == 1, 2, ones == 64) << 6 | (np.cumsum(mixed, axis=1) - mixed)).astype(np.uint8).ravel()
        # the two words that aren't kept come first
        self.kept = np.concatenate([np.array([0, ~np.uint64(0)], np.uint64), words[mixed.ravel() == 1]])
        self.total = int(ones.sum())

    def rank(self, at: np.ndarray) -> np.ndarray:
        """The ones before each place."""
        word, block = at >> 6, at >> 9
        kind = self.kind[word]
        own = self.kept[np.where(kind >= 128, self.first[block] + (kind & 15), kind >> 6)]
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.ones[block].astype(np.int64) + self.within[word] + np.bitwise_count(own & below)

    def bytes(self) -> int:
        return sum(x.nbytes for x in (self.ones, self.within, self.first, self.kind, self.kept))


class WaveletMatrix:
    def __init__(self, sequence: np.ndarray, symbols: int):
        self.bits = max(1, int(symbols - 1).bit_length())
        self.levels, self.zeros = [], []
        for level in range(self.bits):
            bit = ((sequence >> (self.bits - 1 - level)) & 1).astype(bool)
            self.levels.append(Bits(bit))
            self.zeros.append(len(bit) - self.levels[-1].total)
            sequence = np.concatenate([sequence[~bit], sequence[bit]])
        # where each symbol's run begins after the last level
        self.first = np.searchsorted(_reversed(sequence, self.bits), _reversed(np.arange(symbols), self.bits))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        for level, zeros in enumerate(self.zeros):
            ones = self.levels[level].rank(at)
            at = np.where((symbol >> (self.bits - 1 - level)) & 1, zeros + ones, at - ones)
        return at - self.first[symbol]


def _reversed(x: np.ndarray, bits: int) -> np.ndarray:
    """The bits of each number in reverse: the order in which a wavelet matrix leaves its symbols."""
    out = np.zeros_like(x)
    for b in range(bits):
        out |= ((x >> b) & 1) << (bits - 1 - b)
    return out


def _ordered(ranks: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """The order by (rank here, rank `shift` on), and each place's rank in it."""
    n = len(ranks)
    on = np.zeros(n, np.int64)
    on[: n - shift] = ranks[shift:] + 1
    key = ranks * np.int64(n + 1) + on
    order = np.argsort(key, kind="stable")
    step = np.zeros(n, np.int64)
    step[1:] = key[order[1:]] != key[order[:-1]]
    new = np.empty(n, np.int64)
    new[order] = np.cumsum(step)
    return order, new


class FMIndex:
    """words: 64-bit names of all words, sequence by sequence; lengths: of each; times: how often each occurs."""

    def __init__(self, words: np.ndarray, lengths: np.ndarray, times: np.ndarray, window: int):
        self.window, self.lengths = window, lengths.astype(np.int64)
        names, number = np.unique(words, return_inverse=True)
        self.names = names
        # the separator is 0
        ends = np.cumsum(self.lengths)
        self.starts = ends - self.lengths + np.arange(len(ends))
        text = np.zeros(len(words) + len(ends), np.int64)
        inside = np.ones(len(text), bool)
        inside[ends + np.arange(len(ends))] = False
        text[inside] = number + 1
        self.text = text.astype(np.int32)  # the streamed sequences by number; no part of the index
        n = len(text)
        ranks, reach = text, 1
        while 2 * reach <= window:
            ranks, reach = _ordered(ranks, reach)[1], 2 * reach
        if reach < window:
            order, full = _ordered(ranks, window - reach)
        else:
            order, full = np.argsort(ranks, kind="stable"), ranks
        # prefixes of window - 1 words: sequences of a window need it to go on from one word to the next
        shorter = _ordered(ranks, window - 1 - reach)[1] if 0 < window - 1 - reach else ranks if window - 1 == reach else None
        if shorter is None:
            shorter = self._by_depth(text, window - 1)
        edge = np.ones(n + 1, bool)
        edge[1:n] = shorter[order[1:]] != shorter[order[:-1]]
        place = np.arange(n + 1)
        self.low = np.maximum.accumulate(np.where(edge, place, 0))[:n].astype(np.int32)
        self.high = np.minimum.accumulate(np.where(edge, place, n)[::-1])[::-1][1:].astype(np.int32)
        owner = np.repeat(np.arange(len(ends)), self.lengths + 1)
        passed = np.concatenate([[0], np.cumsum(times.astype(np.int64)[owner[order]])])
        self.occurrences = passed.astype(np.int32) if passed[-1] < 1 << 31 else passed
        counts = np.bincount(text, minlength=len(names) + 1)
        self.before = np.cumsum(counts) - counts
        self.wavelet = WaveletMatrix(text[order - 1], len(names) + 1)
        self.size = n

    @staticmethod
    def _by_depth(text: np.ndarray, depth: int) -> np.ndarray:
        ranks, reach = text, 1
        if depth < 1:
            return np.zeros(len(text), np.int64)
        while 2 * reach <= depth:
            ranks, reach = _ordered(ranks, reach)[1], 2 * reach
        return _ordered(ranks, depth - reach)[1] if reach < depth else ranks

    def step(self, low: np.ndarray, high: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of patterns after one more word in front of each."""
        both = self.wavelet.rank(np.concatenate([word, word]), np.concatenate([low, high]))
        base = self.before[word]
        return base + both[: len(word)], base + both[len(word) :]

    def count(self, pattern: np.ndarray) -> int:
        """Occurrences of one pattern of at most `window` words, by backward search."""
        at = np.searchsorted(self.names, pattern)
        if (at >= len(self.names)).any() or (self.names[np.minimum(at, len(self.names) - 1)] != pattern).any():
            return 0
        low, high = np.array([0]), np.array([self.size])
        for w in (at + 1)[::-1]:
            low, high = self.step(low, high, np.array([w]))
            if low[0] >= high[0]:
                return 0
        return int(self.occurrences[high[0]] - self.occurrences[low[0]])

    def window_counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences, in all sequences, of every window of every sequence in turn, and where each one's begin.

        The sequences are streamed against the index from their ends, all in step. The interval of a match of
        `window` words is widened to that of its first window - 1 before the next word, so the matching
        statistics are cut off at the window, and no interval is ever empty: the sequence itself is in it.
        """
        low, high = np.zeros(len(self.lengths), np.int64), np.full(len(self.lengths), self.size)
        windows = np.maximum(0, self.lengths - self.window + 1)
        slots = np.cumsum(windows) - windows
        flat = np.zeros(int(windows.sum()), np.int64)
        by_length = np.argsort(-self.lengths, kind="stable")
        lengths, starts, own = self.lengths[by_length], self.starts[by_length], slots[by_length]
        for done in range(int(lengths[0]) if len(lengths) else 0):
            live = int(np.searchsorted(-lengths, -done, side="left"))  # sequences of more than `done` words
            at = lengths[:live] - 1 - done
            if done >= self.window:
                low[:live], high[:live] = self.low[low[:live]], self.high[low[:live]]
            low[:live], high[:live] = self.step(low[:live], high[:live], self.text[starts[:live] + at])
            if done + 1 >= self.window:
                flat[own[:live] + at] = self.occurrences[high[:live]] - self.occurrences[low[:live]]
        return flat, slots
