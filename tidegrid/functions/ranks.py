"""Order statistics of all sliding windows of an array at once."""

from __future__ import annotations

import numpy as np


class Ranks:
    """A wavelet matrix over the ranks of an array: any order statistic of any window in one step per bit.

    Level by level, from the highest bit of the ranks, values are stably parted by that bit, and a running count of
    zero bits tells where a window's zeros and ones go. All windows are followed together.
    """

    def __init__(self, x: np.ndarray):
        self.values, rank = np.unique(x, return_inverse=True)
        self.bits = max(len(self.values) - 1, 0).bit_length()
        self.zeros = []
        for bit in reversed(range(self.bits)):
            one = (rank >> bit) & 1
            self.zeros.append(np.concatenate(([0], np.cumsum(1 - one))))
            rank = np.concatenate((rank[one == 0], rank[one == 1]))

    def kth(self, begin: np.ndarray, end: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest value (from 0) of each window [begin, end); k must lie in the window."""
        if not len(self.values):
            return np.full(len(k), np.nan)
        rank = np.zeros(len(k), np.int64)
        for bit, zeros in zip(reversed(range(self.bits)), self.zeros):
            low, high, total = zeros[begin], zeros[end], zeros[-1]
            ones = k >= high - low
            k = np.where(ones, k - (high - low), k)
            begin, end = np.where(ones, total + begin - low, low), np.where(ones, total + end - high, high)
            rank |= ones.astype(np.int64) << bit
        return self.values[rank]

    def quantile(self, begin: np.ndarray, end: np.ndarray, p: float) -> np.ndarray:
        """Linearly interpolated quantile of each window; NaN where it is empty."""
        at = np.maximum(end - begin - 1, 0) * p
        low, high = (self._guarded(begin, end, f(at).astype(np.int64)) for f in (np.floor, np.ceil))
        return low + (high - low) * (at - np.floor(at))

    def _guarded(self, begin, end, k):
        some = end > begin
        out = np.full(len(k), np.nan)
        if some.any():
            out[some] = self.kth(begin[some], end[some], k[some])
        return out

    def median_deviation(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Median absolute deviation from the median of each window.

        The deviations of the lower and of the upper half are two sorted sequences of order statistics; how
        many of the smallest come from the lower one is found by bisection.
        """
        n = end - begin
        some = n > 0
        out = np.full(len(n), np.nan)
        begin, end, n = begin[some], end[some], n[some]
        if not len(n):
            return out
        middle = self.quantile(begin, end, 0.5)
        lower = (n + 1) // 2  # values up to the median
        below = lambda i: middle - self.kth(begin, end, np.clip(lower - 1 - i, 0, n - 1))
        above = lambda i: self.kth(begin, end, np.clip(lower + i, 0, n - 1)) - middle

        def smallest(k):
            """The k-th smallest deviation (from 0)."""
            want = k + 1
            a, b = np.maximum(want - (n - lower), 0), np.minimum(want, lower)
            while (a < b).any():
                t = (a + b) // 2
                more = (a < b) & (below(t) < above(want - t - 1))
                a, b = np.where(more, t + 1, a), np.where(more | (a >= b), b, t)
            return np.maximum(np.where(a > 0, below(a - 1), -np.inf), np.where(want - a > 0, above(want - a - 1), -np.inf))

        out[some] = (smallest((n - 1) // 2) + smallest(n // 2)) / 2
        return out
