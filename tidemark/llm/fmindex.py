"""FM-index over word ids: sorted suffixes, wavelet-tree ranks, sampled suffix
positions.  NumPy only; every search step handles all
patterns, or all occurrences, at once.
"""

from __future__ import annotations

import numpy as np


class WaveletTree:
    """Ranks of symbols in a sequence, a bit vector for each bit of a symbol
    (the matrix layout: zeros go before ones at each level).  Bits are packed,
    with a count of ones before each 64 of them: a bit and a half for a bit."""

    def __init__(self, seq: np.ndarray, bits: int):
        self.bits = bits
        self.words: list[np.ndarray] = []
        self.before: list[np.ndarray] = []
        self.zeros: list[int] = []
        for level in range(bits - 1, -1, -1):
            bit = (seq >> level & 1).astype(bool)
            packed = np.zeros(8 * (len(seq) // 64 + 1), np.uint8)
            packed[: (len(seq) + 7) // 8] = np.packbits(bit, bitorder="little")
            words = packed.view("<u8")
            before = np.zeros(len(words), np.int32)
            np.cumsum(np.bitwise_count(words[:-1]), out=before[1:])
            self.words.append(words)
            self.before.append(before)
            self.zeros.append(len(seq) - int(np.count_nonzero(bit)))
            seq = np.concatenate([seq[~bit], seq[bit]])

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        word, low = at >> 6, (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[level][word] + np.bitwise_count(self.words[level][word] & low).astype(np.int64)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often ``symbol`` occurs before position ``at``."""
        start, end = np.zeros(len(at), np.int64), np.asarray(at, np.int64)
        for k, zeros in enumerate(self.zeros):
            one = (symbol >> (self.bits - 1 - k) & 1).astype(bool)
            s, e = self._ones(k, start), self._ones(k, end)
            start, end = np.where(one, zeros + s, start - s), np.where(one, zeros + e, end - e)
        return end - start


class FMIndex:
    """Index of ``seq``, whose symbols are below ``sigma``.  Symbol 0 separates,
    ends the sequence and is in no pattern.

    Separators count as distinct symbols in text order when suffixes are
    sorted (by prefix doubling), so a suffix is compared no further than its
    own separator and copies of a document cost no extra rounds past their
    length.  Steps to a preceding symbol are exact except over a separator, so
    suffixes that follow one are always sampled, besides every ``sample``-th
    position.
    """

    def __init__(self, seq: np.ndarray, sigma: int, sample: int = 8):
        n = self.n = len(seq)
        apart = seq == 0
        m = np.count_nonzero(apart)
        rank = np.where(apart, np.cumsum(apart) - 1, seq.astype(np.int64) + m)
        order, size, unique = np.argsort(rank, kind="stable"), 1, n == m
        while not unique:
            follow = np.zeros(n, np.int64)
            follow[: max(0, n - size)] = rank[size:] + 1
            key = rank * (int(rank.max()) + 2) + follow
            order = np.argsort(key, kind="stable")
            ordered = key[order]
            step = np.zeros(n, np.int64)
            np.cumsum(ordered[1:] != ordered[:-1], out=step[1:])
            rank = np.empty(n, np.int64)
            rank[order] = step
            size *= 2
            unique = step[-1] == n - 1
        self.last = seq[order - 1]  # the symbol before each suffix; before position 0 is the final separator
        self.first = np.zeros(sigma + 1, np.int64)
        np.cumsum(np.bincount(seq, minlength=sigma), out=self.first[1:])
        self.tree = WaveletTree(self.last, max(1, int(sigma - 1).bit_length()))
        marked = (order % sample == 0) | (self.last == 0)
        self.marked_before = np.zeros(n + 1, np.int32)
        np.cumsum(marked, out=self.marked_before[1:])
        self.positions = order[marked]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of padded ``patterns`` (rows), by backward search."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for k in range(patterns.shape[1] - 1, -1, -1):
            on = np.flatnonzero((k < lengths) & (low < high))
            if len(on):
                c = patterns[on, k]
                low[on], high[on] = self.first[c] + self.tree.rank(c, low[on]), self.first[c] + self.tree.rank(c, high[on])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes: walk back to a sampled one and add the steps."""
        out, at, steps = np.empty(len(rows), np.int64), np.asarray(rows, np.int64), 0
        todo = np.arange(len(rows))
        while len(todo):
            done = self.marked_before[at + 1] > self.marked_before[at]
            out[todo[done]] = self.positions[self.marked_before[at[done]]] + steps
            todo, at = todo[~done], at[~done]
            c = self.last[at]
            at = self.first[c] + self.tree.rank(c, at)
            steps += 1
        return out
