"""An FM-index over integer sequences: wavelet-tree ranks, backward search, sampled suffix positions."""

from __future__ import annotations

import numpy as np

#: Every so many positions of the text are kept for locating.
SAMPLE = 8


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffix array of a text whose zeros are separators: each stands for a symbol of its own, smaller than all words, by position.

    Prefix doubling that sorts only what is still tied.
    """
    n = len(text)
    seps = np.cumsum(text == 0)
    first = np.where(text == 0, seps - 1, text.astype(np.int64) + (seps[-1] if n else 0))
    order = np.argsort(first, kind="stable")
    rank = np.empty(n, np.int64)
    start = np.flatnonzero(np.r_[True, first[order][1:] != first[order][:-1]]) if n else np.zeros(0, np.int64)
    rank[order] = np.repeat(start, np.diff(np.r_[start, n]))
    step = 1
    while n:
        at = rank[order]
        same = np.r_[at[1:] == at[:-1], False]
        tied = np.flatnonzero(same | np.r_[False, same[:-1]])
        if not len(tied):
            break
        pos = order[tied]
        after = np.where(pos + step < n, rank[np.minimum(pos + step, n - 1)], -1)
        pos = pos[np.lexsort((after, at[tied]))]
        order[tied] = pos
        group, after = rank[pos], np.where(pos + step < n, rank[np.minimum(pos + step, n - 1)], -1)
        new = np.r_[True, (group[1:] != group[:-1]) | (after[1:] != after[:-1])]
        rank[pos] = tied[np.maximum.accumulate(np.where(new, np.arange(len(tied)), 0))]
        step *= 2
    return order


class WaveletTree:
    """Ranks of symbols in a sequence, level by level from the highest bit (zeros before ones at each level)."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.n = bits, len(symbols)
        self.ones, self.zeros = [], []
        s = symbols
        for b in range(bits - 1, -1, -1):
            bit = (s >> b) & 1
            self.ones.append(np.r_[0, np.cumsum(bit)].astype(np.int32))
            self.zeros.append(len(s) - int(self.ones[-1][-1]))
            s = np.r_[s[bit == 0], s[bit == 1]]

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often symbol stands before position at, for arrays of both."""
        low, high = np.zeros_like(at), at
        for level, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            bit = (symbol >> (self.bits - 1 - level)) & 1
            a, b = ones[low], ones[high]
            low = np.where(bit == 1, zeros + a, low - a)
            high = np.where(bit == 1, zeros + b, high - b)
        return high - low


class FMIndex:
    """text: integers, 0 a separator. Phrases are searched backwards, many at once."""

    def __init__(self, text: np.ndarray):
        text = np.r_[text, 0]
        order = suffix_order(text)
        self.bwt = text[order - 1].astype(np.int64)
        self.top = int(text.max()) + 1
        self.first = np.r_[0, np.cumsum(np.bincount(text, minlength=self.top))].astype(np.int64)
        self.tree = WaveletTree(self.bwt, max(1, self.top.bit_length()))
        marked = order % SAMPLE == 0
        # the walk back of locate stops at separators' successors too: a run's first position is marked
        marked |= self.bwt == 0
        self.rank_marked = np.r_[0, np.cumsum(marked)].astype(np.int64)
        self.marked, self.positions = marked, order[marked]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """phrases: one a row, all of the same length. Rows [low, high) of the suffix array that begin with each."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), len(self.bwt), np.int64)
        alive = np.flatnonzero((phrases < self.top).all(1) & (phrases > 0).all(1))
        high[np.setdiff1d(np.arange(len(phrases)), alive)] = 0
        for column in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[alive, column]
            low[alive] = self.first[c] + self.tree.rank(c, low[alive])
            high[alive] = self.first[c] + self.tree.rank(c, high[alive])
            alive = alive[low[alive] < high[alive]]
        return low, np.maximum(high, low)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix-array rows: each walks back to the nearest sampled position."""
        at, back, out = rows.copy(), 0, np.full(len(rows), -1, np.int64)
        left = np.arange(len(rows))
        while len(left):
            hit = self.marked[at[left]]
            done = left[hit]
            out[done] = self.positions[self.rank_marked[at[done]]] + back
            left = left[~hit]
            c = self.bwt[at[left]]
            at[left] = self.first[c] + self.tree.rank(c, at[left])
            back += 1
        return out
