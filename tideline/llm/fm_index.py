"""An FM-index over a sequence of small integers, all queries vectorised over numpy arrays.

The sequence holds segments with 0 between and after them; symbols are 1 and up.  The wavelet tree is kept level by level
(a wavelet matrix: one bit vector with running counts per bit of a symbol).  Suffix positions are kept for every 16th
place and for every segment start, so that locating steps back at most 15 symbols and never over a separator.
"""

from __future__ import annotations

import numpy as np

SAMPLE = 16


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Order of all suffixes by prefix doubling; every separator counts as a symbol of its own, by place."""
    n = len(seq)
    rank = seq.astype(np.int64)
    zero = np.flatnonzero(seq == 0)
    rank[rank > 0] += len(zero)
    rank[zero] = np.arange(len(zero))
    order, step = np.argsort(rank, kind="stable"), 1
    new = np.r_[0, np.cumsum(np.diff(rank[order]) != 0)]
    rank[order] = new
    while n and new[-1] < n - 1:
        nxt = np.full(n, -1, np.int64)
        nxt[: n - step] = rank[step:]
        key = rank * (n + 1) + nxt + 1
        order = np.argsort(key)
        new = np.r_[0, np.cumsum(np.diff(key[order]) != 0)]
        rank[order] = new
        step *= 2
    return order


class FMIndex:
    def __init__(self, seq: np.ndarray, symbols: int):
        self.n, self.bits = len(seq), max(1, int(symbols).bit_length())
        order = suffix_array(seq)
        bwt = seq[order - 1]
        self.before = np.r_[0, np.cumsum(np.bincount(seq, minlength=symbols + 1))]
        starts = np.zeros(self.n, bool)
        starts[::SAMPLE] = True
        starts[np.flatnonzero(seq == 0)[:-1] + 1] = True
        starts[seq == 0] = True
        self.sampled = starts[order]
        self.sample_at = np.cumsum(self.sampled) - 1
        self.samples = order[self.sampled]
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        level = bwt
        for b in range(self.bits - 1, -1, -1):
            bit = (level >> b & 1).astype(bool)
            self.ones.append(np.r_[0, np.cumsum(bit)].astype(np.int32))
            self.zeros.append(int(len(bit) - bit.sum()))
            level = np.concatenate([level[~bit], level[bit]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of symbol among the first `at` entries of the last column."""
        start = np.zeros_like(at)
        for k, b in enumerate(range(self.bits - 1, -1, -1)):
            one = (symbol >> b & 1).astype(bool)
            i, s = self.ones[k][at], self.ones[k][start]
            at = np.where(one, self.zeros[k] + i, at - i)
            start = np.where(one, self.zeros[k] + s, start - s)
        return at - start

    def _back(self, row: np.ndarray) -> np.ndarray:
        """The row of the suffix that starts one place earlier."""
        at, start, symbol = row, np.zeros_like(row), np.zeros_like(row)
        for k in range(self.bits):
            ones = self.ones[k]
            one = ones[at + 1] > ones[at]
            i, s = ones[at], ones[start]
            at = np.where(one, self.zeros[k] + i, at - i)
            start = np.where(one, self.zeros[k] + s, start - s)
            symbol = symbol * 2 + one
        return self.before[symbol] + at - start

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of the rows of a matrix, one pattern each: the interval of suffixes of every pattern."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        alive = np.arange(len(patterns))
        for t in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[alive, t]
            a = self.before[c] + self.rank(c, lo[alive])
            b = self.before[c] + self.rank(c, hi[alive])
            lo[alive], hi[alive] = a, b
            alive = alive[b > a]
            if not len(alive):
                break
        found = hi > lo
        lo[~found] = hi[~found] = 0
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places in the sequence of suffixes given by row."""
        out, row, steps = np.zeros(len(rows), np.int64), rows.astype(np.int64), 0
        todo = np.arange(len(rows))
        while len(todo):
            done = self.sampled[row]
            out[todo[done]] = self.samples[self.sample_at[row[done]]] + steps
            todo, row = todo[~done], row[~done]
            if len(todo):
                row = self._back(row)
            steps += 1
        return out
