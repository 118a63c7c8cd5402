"""FM-index over word sequences, in numpy.

The indexed sequence holds word ids >= 1 and 0 where a text ends. Every 0 is smaller than every word and different
from every other 0, so no match runs over one and suffixes differ at the next
0 at the latest. Ranks come from a wavelet matrix with popcounts; positions from a
suffix array sampled at every ``sample``-th place of the sequence.
"""

from __future__ import annotations

import numpy as np


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Suffix array of seq by prefix doubling; only unfinished groups are sorted again.

    The first sort packs as many symbols into a key as 63 bits hold. Behind a 0 nothing counts: suffixes that
    are equal up to one are ordered by their place, as the 0s are.
    """
    n = len(seq)
    width = max(1, int(seq.max(initial=0)).bit_length())
    step = max(1, 63 // width)
    key = np.zeros(n, np.int64)
    ended = np.zeros(n, bool)
    for k in range(step):
        symbol = np.zeros(n, np.int64)
        symbol[: max(n - k, 0)] = seq[k:]
        symbol[ended] = 0
        ended |= symbol == 0
        key = (key << width) | symbol
    order = np.argsort(key, kind="stable")
    head = np.empty(n, bool)
    head[:1] = True
    head[1:] = (key[order[1:]] != key[order[:-1]]) | ended[order[1:]]
    starts = np.flatnonzero(head)
    rank = np.empty(n, np.int64)  # a suffix's rank is the place of its group's first
    size = np.diff(np.append(starts, n))
    rank[order] = np.repeat(starts, size)
    todo = np.flatnonzero(np.repeat(size, size) > 1)
    while len(todo):
        at = order[todo]
        after = at + step
        second = np.where(after < n, rank[np.minimum(after, n - 1)], -1)
        first = rank[at]
        by = np.lexsort((second, first))
        at, first, second = at[by], first[by], second[by]
        order[todo] = at
        new = np.empty(len(at), bool)
        new[:1] = True
        new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        group = np.flatnonzero(new)
        sizes = np.diff(np.append(group, len(at)))
        rank[at] = np.repeat(todo[group], sizes)
        todo = todo[np.repeat(sizes, sizes) > 1]
        step *= 2
    return order


class BitRank:
    """A bit vector with constant-time counts of ones before a place."""

    def __init__(self, bits: np.ndarray | None = None, words: np.ndarray | None = None):
        if words is None:
            packed = np.packbits(bits, bitorder="little")
            words = np.zeros(len(bits) // 64 + 1, np.uint64)
            words.view(np.uint8)[: len(packed)] = packed
        self.words = words
        self.before = np.zeros(len(self.words) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])

    def ones(self, i: np.ndarray) -> np.ndarray:
        word = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)


class WaveletMatrix:
    """Counts of a symbol before a place, and the symbol at a place."""

    def __init__(self, seq: np.ndarray, width: int):
        self.levels: list[tuple[int, BitRank, int]] = []
        for shift in range(width - 1, -1, -1):
            bits = ((seq >> shift) & 1).astype(np.uint8)
            self.levels.append((shift, BitRank(bits), int(len(seq) - bits.sum())))
            seq = np.concatenate([seq[bits == 0], seq[bits == 1]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of symbol in the first i places, elementwise."""
        low, high = np.zeros_like(i), i
        for shift, bits, zeros in self.levels:
            one = ((symbol >> shift) & 1).astype(bool)
            a, b = bits.ones(low), bits.ones(high)
            low = np.where(one, zeros + a, low - a)
            high = np.where(one, zeros + b, high - b)
        return high - low

    def at(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbol, its occurrences before i) at each place."""
        symbol = np.zeros_like(i)
        low = np.zeros_like(i)
        for shift, bits, zeros in self.levels:
            one = bits.get(i).astype(bool)
            a, b = bits.ones(low), bits.ones(i)
            low = np.where(one, zeros + a, low - a)
            i = np.where(one, zeros + b, i - b)
            symbol |= one.astype(np.int64) << shift
        return symbol, i - low


class FMIndex:
    """Index of one shard; seq ends with 0."""

    def __init__(self, seq: np.ndarray, symbols: int, sample: int = 16):
        self.n = len(seq)
        order = suffix_array(seq)
        bwt = seq[order - 1].astype(np.int64)
        self.first = np.zeros(symbols + 2, np.int64)
        np.cumsum(np.bincount(seq, minlength=symbols + 1), out=self.first[1 : symbols + 2])
        self.matrix = WaveletMatrix(bwt, max(1, int(symbols).bit_length()))
        # places behind a 0 are sampled, so walking back never steps over a 0, whose rank the matrix doesn't hold
        sampled = (order % sample == 0) | (bwt == 0)
        self.marked = BitRank(sampled.astype(np.uint8))
        self.positions = order[sampled]

    def state(self) -> tuple:
        """What a stored index needs; counts are built again by ``restored``."""
        return self.n, self.first, [(shift, bits.words, zeros) for shift, bits, zeros in self.matrix.levels], self.marked.words, self.positions.astype(np.int32 if self.n < 2**31 else np.int64)

    @classmethod
    def restored(cls, state: tuple) -> FMIndex:
        """Index of a stored state."""
        index = cls.__new__(cls)
        index.matrix = WaveletMatrix.__new__(WaveletMatrix)
        index.n, index.first, levels, marked, index.positions = state
        index.matrix.levels = [(shift, BitRank(words=words), zeros) for shift, words, zeros in levels]
        index.marked = BitRank(words=marked)
        return index

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Half-open suffix ranges of patterns (one per row), by backward search of all at once."""
        low = np.zeros(len(patterns), np.int64)
        high = np.full(len(patterns), self.n, np.int64)
        alive = np.arange(len(patterns))
        for column in range(patterns.shape[1] - 1, -1, -1):
            symbol = patterns[alive, column]
            a = self.first[symbol] + self.matrix.rank(symbol, low[alive])
            b = self.first[symbol] + self.matrix.rank(symbol, high[alive])
            low[alive], high[alive] = a, b
            alive = alive[a < b]
            if not len(alive):
                break
        dead = np.ones(len(patterns), bool)
        dead[alive] = False
        low[dead] = high[dead] = 0
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places in the sequence of suffix rows that start with a word, by walking back to the sampled ones."""
        out = np.empty(len(rows), np.int64)
        left = np.arange(len(rows))
        rows = rows.copy()
        steps = 0
        while len(left):
            hit = self.marked.get(rows).astype(bool)
            out[left[hit]] = self.positions[self.marked.ones(rows[hit])] + steps
            left, rows = left[~hit], rows[~hit]
            if len(left):
                symbol, before = self.matrix.at(rows)
                rows = self.first[symbol] + before
            steps += 1
        return out
