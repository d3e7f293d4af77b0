"""A compressed index of a sequence of symbols: the Burrows-Wheeler transform in a wavelet matrix, searched backward."""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """The order of all suffixes, by doubling the sorted prefix; each 0 is a separator smaller than all symbols, an earlier one smaller than a later one."""
    n = len(symbols)
    separators = np.cumsum(symbols == 0)
    rank = np.where(symbols == 0, separators - 1, symbols + separators[-1]).astype(np.int64)
    step = 1
    while True:
        following = np.zeros(n, np.int64)
        following[:-step] = rank[step:] + 1 if step < n else 0
        key = rank * (n + symbols.max(initial=0) + 2) + following
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.diff(key[order], prepend=key[order[0]]) != 0)
        if new[order[-1]] == n - 1 or step >= n:
            return order
        rank, step = new, 2 * step


class WaveletMatrix:
    """Symbols below ``sigma`` by bits, highest first: a packed row of bits a level, with counts every 64."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels = max(1, int(sigma - 1).bit_length())
        self.bits, self.counts, self.zeros = [], [], []
        self.begin = np.zeros(sigma, np.int64)
        codes = np.arange(sigma)
        for level in range(self.levels - 1, -1, -1):
            bit = (symbols >> level & 1).astype(bool)
            padded = np.zeros((len(bit) // 64 + 1) * 64, bool)
            padded[: len(bit)] = bit
            words = np.packbits(padded, bitorder="little").view(np.uint64)
            self.bits.append(words)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int32)]).astype(np.int32))
            self.zeros.append(len(bit) - int(bit.sum()))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])
            self.begin = self._down(len(self.bits) - 1, codes >> level & 1, self.begin)

    def _down(self, k: int, bit: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the places ``at`` of level ``k`` lie on the next one."""
        word = at >> 6
        below = self.bits[k][word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        ones = self.counts[k][word] + np.bitwise_count(below).astype(np.int64)
        return np.where(bit, self.zeros[k] + ones, at - ones)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before the place ``at``."""
        begin = self.begin[symbol]
        for k in range(self.levels):
            at = self._down(k, symbol >> (self.levels - 1 - k) & 1, at)
        return at - begin


class FmIndex:
    """Index of ``symbols`` from 1 on, with 0 between and after sequences."""

    def __init__(self, symbols: np.ndarray):
        sigma = int(symbols.max(initial=0)) + 1
        order = suffix_array(symbols)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=sigma))])
        self.tree = WaveletMatrix(symbols[order - 1], sigma)

    def search(self, text: np.ndarray, ends: np.ndarray, length: int, least: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics of ``text`` up to ``length``: (match, low, high) for each of ``ends``.

        The longest suffix of ``text[:end]`` of at most ``length`` symbols that occurs at least
        ``least`` times in the index has ``match`` symbols; its suffixes are low to high of the sorted ones.
        """
        match = np.zeros(len(ends), np.int64)
        low, high = np.zeros(len(ends), np.int64), np.full(len(ends), self.before[-1])
        active = np.arange(len(ends))
        for k in range(length):
            at = ends[active] - 1 - k
            active = active[at >= 0]
            symbol = text[at[at >= 0]]
            both = self.tree.rank(np.concatenate([symbol, symbol]), np.concatenate([low[active], high[active]]))
            a, b = both[: len(active)] + self.before[symbol], both[len(active) :] + self.before[symbol]
            keep = (b - a >= least) & (symbol > 0)
            active = active[keep]
            low[active], high[active], match[active] = a[keep], b[keep], k + 1
            if not len(active):
                break
        return match, low, high
