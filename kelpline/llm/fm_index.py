"""An FM-index over integer symbols, in numpy: wavelet matrix, sampled suffix positions.

The indexed text is a concatenation of runs; each run ends in a separator of
its own (symbol 0 in the transform), so no match crosses runs and suffixes
differ within one run's length.
"""

from __future__ import annotations

import numpy as np


class WaveletMatrix:
    """rank(c, i): how often c is among the first i symbols, for arrays of c and i."""

    def __init__(self, symbols: np.ndarray, alphabet: int):
        self.bits = max(int(alphabet - 1).bit_length(), 1)
        self.zeros, self.ones = [], []
        for level in range(self.bits - 1, -1, -1):
            bit = (symbols >> level) & 1
            ones = np.zeros(len(symbols) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(symbols) - int(ones[-1]))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        lo, hi = np.zeros(len(c), np.int64), i.astype(np.int64)
        for k, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            bit = ((c >> (self.bits - 1 - k)) & 1).astype(bool)
            a, b = ones[lo].astype(np.int64), ones[hi].astype(np.int64)
            lo, hi = np.where(bit, zeros + a, lo - a), np.where(bit, zeros + b, hi - b)
        return hi - lo


def suffix_order(text: np.ndarray) -> np.ndarray:
    """The sorted suffixes of a text whose separators (0) each count as smaller than the next separator."""
    n = len(text)
    breaks = np.flatnonzero(text == 0)
    rank = text.astype(np.int64) + len(breaks)
    rank[breaks] = np.arange(len(breaks))
    step = 1
    while True:
        second = np.full(n, -1, np.int64)
        second[: n - step] = rank[step:]
        key = rank * (n + int(text.max(initial=0)) + 2) + second + 1
        order = np.argsort(key, kind="stable")
        fresh = np.empty(n, np.int64)
        fresh[order] = np.cumsum(np.concatenate([[0], key[order][1:] != key[order][:-1]])) if n else []
        if n == 0 or fresh[order[-1]] == n - 1:
            return order
        rank, step = fresh, 2 * step


class FMIndex:
    """Index of ``text`` (symbols 1..alphabet-1, 0 separates; must end in 0)."""

    SAMPLE = 8

    def __init__(self, text: np.ndarray, alphabet: int):
        self.size = len(text)
        order = suffix_order(text)
        last = text[order - 1]  # of suffix 0 the final separator
        self.wavelet = WaveletMatrix(last.astype(np.int64), alphabet)
        self.last = last
        self.below = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=alphabet))])
        self.sampled = (order % self.SAMPLE == 0) | (last == 0)
        self.sample_rank = np.concatenate([[0], np.cumsum(self.sampled)])
        self.positions = order[self.sampled]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix range [lo, hi) of each phrase (rows of equal length), by backward search."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.size, np.int64)
        alive = np.arange(len(phrases))
        for k in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[alive, k].astype(np.int64)
            lo[alive] = self.below[c] + self.wavelet.rank(c, lo[alive])
            hi[alive] = self.below[c] + self.wavelet.rank(c, hi[alive])
            alive = alive[lo[alive] < hi[alive]]
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: step back by last-to-first mapping until a sampled row."""
        out = np.zeros(len(rows), np.int64)
        at, open_, steps = rows.astype(np.int64), np.arange(len(rows)), 0
        while len(open_):
            here = at[open_]
            done = self.sampled[here]
            out[open_[done]] = self.positions[self.sample_rank[here[done]]] + steps
            open_, here = open_[~done], here[~done]
            c = self.last[here].astype(np.int64)
            at[open_] = self.below[c] + self.wavelet.rank(c, here)
            steps += 1
        return out
