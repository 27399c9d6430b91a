"""A compressed full-text index (FM-index) over sequences of word hashes, queried many patterns at a time.

The Burrows-Wheeler transform of the shard lies in a wavelet tree: one packed bit vector per bit of a symbol with a
running count per 64-bit word. Backward search walks it for all patterns of a batch in step.
"""

from __future__ import annotations

import numpy as np


class Bits:
    """A packed bit vector that counts ones before a position."""

    def __init__(self, bits: np.ndarray):
        self.n = len(bits)
        packed = np.packbits(bits, bitorder="little")
        words = np.zeros((self.n >> 6) + 1, np.uint64)
        words.view(np.uint8)[:len(packed)] = packed
        self.words = words
        self.before = np.zeros(len(words) + 1, np.int64)
        np.cumsum(np.bitwise_count(words), out=self.before[1:])

    def ones(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & low)


class Wavelet:
    """A sequence of small integers that counts a symbol before a position; levels from the highest bit down."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.levels = max(1, int(size - 1).bit_length())
        self.bits, self.zeros = [], []
        s = symbols
        for level in range(self.levels - 1, -1, -1):
            one = (s >> level & 1).astype(bool)
            self.bits.append(Bits(one))
            s = np.concatenate([s[~one], s[one]])
            self.zeros.append(self.bits[-1].n - int(self.bits[-1].before[-1]))

    def steps(self, symbol: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where ``start`` and ``end`` arrive at the bottom of the tree on the way of ``symbol``."""
        at = np.concatenate([start, end])
        way = np.concatenate([symbol, symbol])
        for level, (bits, zeros) in enumerate(zip(self.bits, self.zeros)):
            ones = bits.ones(at)
            right = (way >> (self.levels - 1 - level) & 1).astype(bool)
            at = np.where(right, zeros + ones, at - ones)
        return at[:len(start)], at[len(start):]


def _suffixes(text: np.ndarray, depth: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix array by doubling, up to ``depth`` symbols, and the class of each suffix by its first 1, 2, 4, ... symbols.

    Suffixes that agree so far are in text order. Separators make every longer run end.
    """
    n = len(text)
    classes = [text.astype(np.int32)]
    length = 1
    while length < depth:
        c = classes[-1]
        ahead = np.zeros(n, np.int64)
        ahead[:max(n - length, 0)] = c[length:] + 1  # a text shorter than the step has nothing ahead
        key = c * np.int64(int(c.max()) + 2) + ahead
        order = np.argsort(key)
        rank = np.empty(n, np.int32)
        sorted_ = key[order]
        rank[order] = np.cumsum(np.r_[False, sorted_[1:] != sorted_[:-1]], dtype=np.int32)
        classes.append(rank)
        length *= 2
    return np.argsort(classes[-1], kind="stable"), classes


class Index:
    """The index of a shard: passages of at most ``2 * window`` words, each with the number of its owner.

    ``places`` of ``window`` consecutive words form one run of the suffix order; the index keeps the bounds of these
    runs, and of the runs for one word less, so a match can drop its last word while it grows at the front.
    """

    def __init__(self, passages: list[np.ndarray], owners: np.ndarray, window: int):
        self.window = window
        sizes = np.array([len(p) for p in passages])
        if sizes.max() > 2 * window:
            raise ValueError("passages are at most twice the window")
        words, codes = np.unique(np.concatenate(passages), return_inverse=True)
        self.vocabulary = words
        ends = np.cumsum(sizes + 1)
        text = np.zeros(int(ends[-1]), np.int64)  # symbol 0 ends a passage
        inside = np.ones(len(text), bool)
        inside[ends - 1] = False
        text[inside] = codes + 1
        order, classes = _suffixes(text, 2 * window + 1)
        before = text[order - 1]
        self.n = len(text)
        self.first = np.searchsorted(text[order], np.arange(len(words) + 2))
        self.tree = Wavelet(before, len(words) + 1)
        # The tree's bottom holds symbols in bit order: a symbol's block starts where position 0 arrives.
        at0, _ = self.tree.steps(np.arange(len(words) + 1), np.zeros(len(words) + 1, np.int64), np.zeros(len(words) + 1, np.int64))
        self.shift = self.first[:-1] - at0
        self.full = self._bounds(order, classes, window)
        self.short = self._bounds(order, classes, window - 1)
        self.run = np.cumsum(self.full) - 1
        self.run_start = np.flatnonzero(self.full)
        owner = np.repeat(owners, sizes + 1)[order]
        self.least = np.minimum.reduceat(owner, self.run_start)
        self.short_start = np.flatnonzero(self.short)
        self.short_run = np.cumsum(self.short) - 1

    @staticmethod
    def _bounds(order, classes, length) -> np.ndarray:
        """True where a suffix differs from the one before it within ``length`` symbols."""
        differs = np.zeros(len(order), bool)
        differs[0] = True
        at = 0
        for power in range(len(classes) - 1, -1, -1):
            if length - at >= 1 << power:
                place = order + at
                ok = place < len(order)
                c = np.where(ok, classes[power][np.minimum(place, len(order) - 1)], -1)
                differs[1:] |= c[1:] != c[:-1]
                at += 1 << power
        return differs

    def extend(self, start: np.ndarray, end: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of backward search: the suffixes that begin with ``symbol`` before what matched so far."""
        a, b = self.tree.steps(symbol, start, end)
        return a + self.shift[symbol], b + self.shift[symbol]

    def owners_of(self, passages: list[np.ndarray]) -> list[np.ndarray]:
        """For each passage, of each of its windows the smallest owner in the shard; -1 where there is none.

        All passages run in step from right to left. The match is kept at one word less than the window, so a step
        makes a window, reports its run, and drops the last word again. A passage whose match breaks starts anew at
        the next window.
        """
        sizes = np.array([len(p) for p in passages])
        width = int(sizes.max())
        code = np.zeros((len(passages), width), np.int64)  # right-aligned
        for i, p in enumerate(passages):
            at = np.minimum(np.searchsorted(self.vocabulary, p), len(self.vocabulary) - 1)
            code[i, width - len(p):] = np.where(self.vocabulary[at] == p, at + 1, 0)
        order = np.argsort(-sizes, kind="stable")
        found = np.full((len(passages), width), -1, np.int64)
        start, end = np.zeros(len(passages), np.int64), np.full(len(passages), self.n)
        matched = np.zeros(len(passages), np.int64)
        live = len(order)
        sorted_sizes = sizes[order]
        for step in range(width):
            while live and sorted_sizes[live - 1] <= step:
                live -= 1
            rows = order[:live]
            column = width - 1 - step
            symbol = code[rows, column]
            known = symbol > 0
            s, e = self.extend(start[rows], end[rows], symbol)
            hit = known & (e > s)
            lost = rows[~hit]
            start[rows], end[rows] = s, e
            matched[rows] += 1
            if len(lost):
                for r in lost.tolist():  # rare: only passages that aren't in the index as a whole
                    start[r], end[r], matched[r] = self._again(code[r], column, width)
            ready = rows[matched[rows] == self.window]
            if len(ready):
                run = self.run[start[ready]]
                found[ready, column] = self.least[run]
                k = self.short_run[start[ready]]
                start[ready] = self.short_start[k]
                end[ready] = np.append(self.short_start, self.n)[k + 1]
                matched[ready] -= 1
        return [found[i, width - n:width - self.window + 1] for i, n in enumerate(sizes)]

    def _again(self, code: np.ndarray, column: int, width: int) -> tuple[int, int, int]:
        """The longest match, shorter than the window, that starts at ``column``."""
        for length in range(min(self.window - 1, width - column), 0, -1):
            start, end = np.zeros(1, np.int64), np.full(1, self.n)
            for at in range(column + length - 1, column - 1, -1):
                if code[at] == 0:
                    break
                start, end = self.extend(start, end, code[at:at + 1])
                if end[0] <= start[0]:
                    break
            else:
                return int(start[0]), int(end[0]), length
        return 0, self.n, 0
