"""An FM-index over word numbers, held by one task for one shard: wavelet ranks, backward search, sampled locations.

All searches of a shard run at once: a step takes one word of every phrase and narrows all ranges together.
"""

from __future__ import annotations

import numpy as np

from cellwright.llm.suffix_dedup import suffix_array

SAMPLE = 16


class FMIndex:
    def __init__(self, symbols: np.ndarray, alphabet: int):
        """``symbols``: numbers from 1 up to ``alphabet`` - 1; 0 is the end mark, added here."""
        t = np.append(symbols, 0).astype(np.int64)
        sa = suffix_array(t)
        self.n = len(t)
        bwt = t[sa - 1]
        self.before = np.concatenate([[0], np.cumsum(np.bincount(t, minlength=alphabet))])
        self.bits = range(max(1, (alphabet - 1).bit_length()) - 1, -1, -1)
        self.ones, self.zeros = [], []
        level = bwt
        for b in self.bits:
            bit = (level >> b) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit, dtype=np.int32)]).astype(np.int32))
            self.zeros.append(int(self.n - self.ones[-1][-1]))
            level = np.concatenate([level[bit == 0], level[bit == 1]])
        self.base = self._down(np.arange(alphabet), np.zeros(alphabet, np.int64))
        self.bwt = bwt.astype(np.int32)
        self.marked = sa % SAMPLE == 0
        self.sampled = sa[self.marked]
        self.marks = np.concatenate([[0], np.cumsum(self.marked)])

    def _down(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for b, ones, zeros in zip(self.bits, self.ones, self.zeros, strict=True):
            r = ones[i]
            i = np.where((c >> b) & 1, zeros + r, i - r)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often c stands in the first i places of the transformed text."""
        return self._down(c, i) - self.base[c]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of the rows of a matrix of words: the range of suffixes that each one starts."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        live = np.arange(len(phrases))
        for j in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[live, j]
            lo[live] = self.before[c] + self.rank(c, lo[live])
            hi[live] = self.before[c] + self.rank(c, hi[live])
            live = live[hi[live] > lo[live]]
        hi = np.maximum(hi, lo)
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places of suffixes, by steps to the left until one whose place was kept."""
        rows, out, steps = rows.copy(), np.zeros(len(rows), np.int64), 0
        live = np.arange(len(rows))
        while len(live):
            known = self.marked[rows[live]]
            at = live[known]
            out[at] = self.sampled[self.marks[rows[at]]] + steps
            live = live[~known]
            c = self.bwt[rows[live]].astype(np.int64)
            rows[live] = self.before[c] + self.rank(c, rows[live])
            steps += 1
            assert steps < SAMPLE or not len(live), "a step to the left must meet a kept place"
        return out
