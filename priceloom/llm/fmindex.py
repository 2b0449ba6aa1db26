"""An FM-index over a sequence of small integers: wavelet-matrix ranks and sampled suffix positions, in NumPy.

All operations take arrays of queries. Inside, symbols are one higher than outside, and 0 is the end mark alone: were
it a separator too, steps from a suffix to the one before it would go astray.
"""

import numpy as np

SAMPLE = 8


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Prefix doubling; equal prefixes are told apart by twice their length until all suffixes differ."""
    n = len(seq)
    rank = np.unique(seq, return_inverse=True)[1].astype(np.int64)
    width = 1
    while True:
        after = np.zeros(n, np.int64)
        after[: max(0, n - width)] = rank[width:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        if rank[order[-1]] == n - 1:
            return order
        width *= 2


class FMIndex:
    def __init__(self, seq: np.ndarray):
        """seq: symbols from 0 on."""
        seq = np.append(np.asarray(seq, np.int64) + 1, 0)
        order = suffix_array(seq)
        bwt = seq[order - 1]
        self.n, self.bits = len(seq), max(1, int(seq.max()).bit_length())
        counts = np.bincount(seq, minlength=1 << self.bits)
        self.first = np.concatenate([[0], np.cumsum(counts)])
        self.ones, self.zeros = [], []
        level = bwt
        for b in reversed(range(self.bits)):
            bit = (level >> b) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(int(self.n - self.ones[-1][-1]))
            level = np.concatenate([level[bit == 0], level[bit == 1]])
        sampled = order % SAMPLE == 0
        self.marks = np.concatenate([[0], np.cumsum(sampled)]).astype(np.int32)
        self.sampled, self.samples = sampled, order[sampled]
        self.bwt = bwt

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often the symbol occurs among the first `upto` symbols of the transform."""
        begin, end = np.zeros_like(upto), upto
        for b, ones, zeros in zip(reversed(range(self.bits)), self.ones, self.zeros, strict=True):
            bit = (symbol >> b) & 1 == 1
            begin = np.where(bit, zeros + ones[begin], begin - ones[begin])
            end = np.where(bit, zeros + ones[end], end - ones[end])
        return end - begin

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of suffixes that begin with each row of phrases, which are as long as one another."""
        phrases = phrases + 1
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        live = np.flatnonzero((phrases < 1 << self.bits).all(axis=1))
        dead = np.ones(len(phrases), bool)
        dead[live] = False
        high[dead] = 0
        for symbol in phrases.T[::-1]:
            low[live] = self.first[symbol[live]] + self.rank(symbol[live], low[live])
            high[live] = self.first[symbol[live]] + self.rank(symbol[live], high[live])
            live = live[low[live] < high[live]]
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Where those suffixes begin: step back to a sampled one and count the steps."""
        rows, steps, found = rows.copy(), np.zeros(len(rows), np.int64), np.full(len(rows), -1, np.int64)
        open_ = np.arange(len(rows))
        while len(open_):
            at = rows[open_]
            hit = self.sampled[at]
            done = open_[hit]
            found[done] = self.samples[self.marks[rows[done]]] + steps[done]
            open_ = open_[~hit]
            symbol = self.bwt[rows[open_]]
            rows[open_] = self.first[symbol] + self.rank(symbol, rows[open_])
            steps[open_] += 1
        return found
