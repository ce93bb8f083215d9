"""Count, sum and spread of all windows of an array at once."""

from __future__ import annotations

import numpy as np


def _joined(a, b):
    """Count, sum, mean and squared deviations of two parts taken together."""
    (n, s, m, q), (n2, s2, m2, q2) = a, b
    total, gap = n + n2, m2 - m
    share = n2 / np.where(total > 0, total, 1)
    mean = np.where(n2 == 0, m, np.where(n == 0, m2, m + gap * share))
    dev = np.where(n2 == 0, q, np.where(n == 0, q2, q + q2 + gap * gap * n * share))
    return total, s + s2, mean, dev


class Moments:
    """Parts of 1, 2, 4, ... values, each joined from two: any window is joined from a few, so equal values have no spread
    and nothing is subtracted from totals of the whole array."""

    def __init__(self, x: np.ndarray, there: np.ndarray):
        x = np.where(there, x, 0.0)
        self.levels = [(there.astype(float), x, x, np.zeros(len(x)))]
        while len(self.levels[-1][0]) > 1:
            last = [np.append(c, 0.0) if len(c) % 2 else c for c in self.levels[-1]]
            self.levels.append(_joined([c[::2] for c in last], [c[1::2] for c in last]))

    def of(self, begin: np.ndarray, end: np.ndarray):
        """Count, sum and squared deviations from the mean of each window [begin, end)."""
        begin, end = begin.copy(), np.maximum(end, begin)
        found = [np.zeros(len(begin)) for _ in range(4)]
        for level in self.levels:
            for odd, at in ((begin & 1, begin), (end & 1, end - 1)):
                i = np.flatnonzero((begin < end) & (odd == 1))
                for f, c in zip(found, _joined([f[i] for f in found], [c[at[i]] for c in level])):
                    f[i] = c
                if at is begin:
                    begin[i] += 1
                else:
                    end[i] -= 1
            begin, end = begin >> 1, end >> 1
        return found[0].astype(np.int64), found[1], found[3]
