"""An FM-index over word ids with a wavelet matrix, searched for many patterns at once."""

from __future__ import annotations

import numpy as np


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions of text sorted by their next ``depth`` symbols (doubling); ties by position."""
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    n, width = len(text), 1
    while True:
        if width >= depth or rank.max() == n - 1:
            return np.argsort(rank, kind="stable")
        ahead = np.zeros(n, np.int64)
        ahead[: n - width] = rank[width:] + 1
        pair = rank * (n + 1) + ahead
        order = np.argsort(pair, kind="stable")
        step = np.append(0, (pair[order][1:] != pair[order][:-1]).astype(np.int64))
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(step)
        width *= 2


class WaveletMatrix:
    """Rank queries over a sequence of small integers, one bit plane a level."""

    def __init__(self, seq: np.ndarray, sigma: int):
        self.bits = max(1, int(sigma - 1).bit_length())
        self.planes: list[tuple[np.ndarray, np.ndarray, int]] = []
        now = seq.astype(np.int64)
        for level in range(self.bits - 1, -1, -1):
            bit = ((now >> level) & 1).astype(bool)
            packed = np.packbits(np.append(bit, np.zeros(128 - len(bit) % 64, bool)), bitorder="little").view(np.uint64)
            ones = np.bitwise_count(packed).astype(np.int64)
            self.planes.append((packed, np.cumsum(ones) - ones, int(len(bit) - bit.sum())))
            now = np.concatenate([now[~bit], now[bit]])
        symbols = np.arange(sigma)
        self.base = self._descend(symbols, np.zeros(sigma, np.int64))

    def _descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, (packed, before, zeros) in zip(range(self.bits - 1, -1, -1), self.planes, strict=True):
            word = at >> 6
            ones = before[word] + np.bitwise_count(packed[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))
            at = np.where((symbol >> level) & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of symbol[i] among the first at[i] entries."""
        return self._descend(symbol, at) - self.base[symbol]


class FMIndex:
    """Index of pieces (arrays of positive ids) that tells the least owner of all occurrences of a pattern."""

    def __init__(self, pieces: list[np.ndarray], owner: np.ndarray):
        lengths = np.array([len(p) + 1 for p in pieces])
        text = np.concatenate([np.append(p, 0) for p in pieces]).astype(np.int64)
        depth = int(lengths.max())
        order = suffix_order(text, depth)
        sigma = int(text.max()) + 1
        self.n = len(text)
        self.tree = WaveletMatrix(text[order - 1], sigma)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])[:-1]
        least = np.repeat(owner, lengths)[order]
        self.least = [least]
        width = 1
        while 2 * width <= self.n:
            last = self.least[-1]
            self.least.append(np.minimum(last[: len(last) - width], last[width:]))
            width *= 2

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One backward step: the suffix range of symbol + pattern from that of pattern."""
        both = self.tree.rank(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        start = self.first[symbol]
        return start + both[: len(low)], start + both[len(low) :]

    def least_owner(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The least owner in each non-empty suffix range."""
        out = np.empty(len(low), self.least[0].dtype)
        level = np.frexp((high - low).astype(float))[1] - 1
        for k in np.unique(level):
            at = level == k
            table = self.least[k]
            out[at] = np.minimum(table[low[at]], table[high[at] - (1 << int(k))])
        return out

    def earlier_matches(self, pieces: list[np.ndarray], owner: np.ndarray, threshold: int) -> list[tuple[int, int, int]]:
        """Matching statistics of each piece against pieces of smaller owners, right ends first.

        Yields (piece, start, stop) of at least ``threshold`` symbols; together
        they cover every window of that length that a smaller owner has.
        """
        found: list[tuple[int, int, int]] = []
        offsets = np.cumsum([0] + [len(p) for p in pieces])
        flat = np.concatenate(pieces).astype(np.int64)
        who = np.array([i for i, p in enumerate(pieces) if len(p) >= threshold], np.int64)
        end = np.array([len(pieces[i]) for i in who], np.int64)
        left = end.copy()
        low, high = np.zeros(len(who), np.int64), np.full(len(who), self.n, np.int64)
        while len(who):
            can = left > 0
            new_low, new_high = self.extend(flat[offsets[who] + np.maximum(left - 1, 0)], low, high)
            fits = can & (new_high > new_low)
            fits[fits] = self.least_owner(new_low[fits], new_high[fits]) < owner[who[fits]]
            done = ~fits
            long = done & (end - left >= threshold)
            found += zip(who[long].tolist(), left[long].tolist(), end[long].tolist(), strict=True)
            next_end = np.where(long, left + threshold - 1, end - 1)
            left = np.where(fits, left - 1, next_end)
            low, high = np.where(fits, new_low, 0), np.where(fits, new_high, self.n)
            end = np.where(fits, end, next_end)
            keep = fits | ((end >= threshold) & ~(done & long & (end - threshold < 0)))
            who, end, left, low, high = who[keep], end[keep], left[keep], low[keep], high[keep]
        return found
