"""An FM-index over a sequence of integer codes: suffix order, wavelet-tree ranks, sampled suffix positions."""

from __future__ import annotations

import numpy as np


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes in their order, by prefix doubling. The last code has to be the only 0."""
    n = len(text)
    _, rank = np.unique(text, return_inverse=True)
    rank = rank.astype(np.int64)
    order, k = np.argsort(rank, kind="stable"), 1
    while True:
        key = rank * (n + 1)
        key[: n - k] += rank[k:] + 1
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        k *= 2
        if rank[order[-1]] == n - 1 or k >= n:
            return order


class WaveletTree:
    """Ranks of codes in prefixes of a sequence, a level per bit of a code (levels side by side: a wavelet matrix)."""

    def __init__(self, codes: np.ndarray, top: int):
        self.bits = max(1, int(top).bit_length())
        self.ones: list[np.ndarray] = []
        now = codes.astype(np.int64)
        for level in range(self.bits - 1, -1, -1):
            bit = ((now >> level) & 1).astype(bool)
            ones = np.zeros(len(now) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            now = np.concatenate([now[~bit], now[bit]])
        self.start = self._down(np.arange(top + 1), np.zeros(top + 1, np.int64))

    def _down(self, code: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, ones in enumerate(self.ones):
            one = ones[at]
            at = np.where((code >> (self.bits - 1 - level)) & 1, len(ones) - 1 - ones[-1] + one, at - one)
        return at

    def rank(self, code: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each code occurs before each place."""
        return self._down(code, at) - self.start[code]

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(code at each place, its rank there)."""
        code = np.zeros(len(at), np.int64)
        for ones in self.ones:
            one = ones[at]
            bit = ones[at + 1] - one
            code = 2 * code + bit
            at = np.where(bit, len(ones) - 1 - ones[-1] + one, at - one)
        return code, at - self.start[code]


class FMIndex:
    def __init__(self, text: np.ndarray, top: int, sample: int = 16):
        """text: codes from 1 to top; a final 0 is added here."""
        text = np.concatenate([text.astype(np.int64), [0]])
        order = suffix_order(text)
        self.size = len(text)
        self.tree = WaveletTree(text[order - 1], top)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top + 1))])
        self.sampled = order % sample == 0
        self.sample_rank = np.cumsum(self.sampled) - 1
        self.samples = order[self.sampled]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of phrases, first and end of its range of suffixes) of those of equal length that occur."""
        which = np.arange(len(phrases))
        last = phrases[:, -1]
        low, high = self.before[last], self.before[last + 1]
        for j in range(phrases.shape[1] - 2, -1, -1):
            live = high > low
            which, low, high = which[live], low[live], high[live]
            if not len(which):
                break
            code = phrases[which, j]
            low = self.before[code] + self.tree.rank(code, low)
            high = self.before[code] + self.tree.rank(code, high)
        live = high > low
        return which[live], low[live], high[live]

    def locate(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Text positions of the suffixes in the ranges, range by range."""
        n = high - low
        row = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)
        out, todo, steps = np.zeros(len(row), np.int64), np.arange(len(row)), 0
        while len(todo):
            hit = self.sampled[row]
            out[todo[hit]] = self.samples[self.sample_rank[row[hit]]] + steps
            todo, row = todo[~hit], row[~hit]
            code, rank = self.tree.access(row)
            row = self.before[code] + rank
            steps += 1
        return out
