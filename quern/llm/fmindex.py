"""An FM-index over integer sequences: wavelet matrix of the Burrows-Wheeler transform, sampled suffix positions."""

from __future__ import annotations

import numpy as np


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Suffixes of seq in order; 0 is a separator, and what follows one doesn't count: such ties go by position.

    Prefix doubling from four symbols on.
    """
    n = len(seq)
    if n == 0:
        return np.zeros(0, np.int64)
    ends = np.nonzero(seq == 0)[0]
    nxt = np.searchsorted(ends, np.arange(n))
    left = np.where(nxt < len(ends), np.append(ends, n)[nxt], n) - np.arange(n)  # words before the next separator
    width = max(1, int(seq.max()).bit_length())
    h = max(1, min(4, 62 // width))
    key = np.zeros(n, np.int64)
    for k in range(h):
        part = np.zeros(n, np.int64)
        part[: max(0, n - k)] = seq[k:]
        part[left <= k] = 0
        key = key << width | part
    while True:
        order = np.argsort(key)
        ranked = key[order]
        new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new) - 1
        alone = new & np.append(new[1:], True)
        open_ = np.empty(n, bool)
        open_[order] = ~alone
        if not (open_ & (left >= h)).any():
            return np.argsort(rank * n + np.arange(n))
        follow = np.zeros(n, np.int64)
        follow[: max(0, n - h)] = rank[h:] + 1
        follow[left < h] = 0
        key = rank * (n + 1) + follow
        h *= 2


class WaveletMatrix:
    """Rank and access over symbols below 2**bits."""

    def __init__(self, seq: np.ndarray, bits: int):
        self.n, self.bits = len(seq), bits
        self.words, self.before, self.zeros = [], [], []
        cur = seq.astype(np.uint32)
        for b in range(bits - 1, -1, -1):
            one = (cur >> np.uint32(b) & np.uint32(1)).astype(bool)
            packed = np.zeros((self.n + 63) // 64 * 8 + 8, np.uint8)
            raw = np.packbits(one, bitorder="little")
            packed[: len(raw)] = raw
            w = packed.view(np.uint64)
            self.words.append(w)
            self.before.append(np.concatenate([[0], np.cumsum(np.bitwise_count(w), dtype=np.int64)[:-1]]))
            self.zeros.append(int(self.n - one.sum()))
            cur = np.concatenate([cur[~one], cur[one]])

    def _ones(self, level: int, i: np.ndarray) -> np.ndarray:
        w = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[level][w] + np.bitwise_count(self.words[level][w] & mask)

    def rank(self, sym: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often sym stands before i."""
        lo, hi = np.zeros(len(i), np.int64), i.astype(np.int64)
        for level in range(self.bits):
            one = (sym >> (self.bits - 1 - level) & 1).astype(bool)
            a, b = self._ones(level, lo), self._ones(level, hi)
            lo, hi = np.where(one, self.zeros[level] + a, lo - a), np.where(one, self.zeros[level] + b, hi - b)
        return hi - lo

    def access_rank(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at i, and how often it stands before i."""
        lo, pos, sym = np.zeros(len(i), np.int64), i.astype(np.int64), np.zeros(len(i), np.int64)
        for level in range(self.bits):
            one = (self.words[level][pos >> 6] >> (pos & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            a, b = self._ones(level, lo), self._ones(level, pos)
            sym = sym << 1 | one
            lo, pos = np.where(one, self.zeros[level] + a, lo - a), np.where(one, self.zeros[level] + b, pos - b)
        return sym, pos - lo


class FMIndex:
    """Of a sequence of symbols 1.. with 0 between its runs. Every SAMPLE-th position and each run's first is kept."""

    SAMPLE = 8

    def __init__(self, seq: np.ndarray, top: int):
        self.n = n = len(seq)
        sa = suffix_array(seq)
        self.bwt = WaveletMatrix(seq[sa - 1] if n else seq, max(1, top.bit_length()))
        self.first = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=top + 1))])
        start = np.concatenate([[True], seq[:-1] == 0]) if n else np.zeros(0, bool)
        kept = (np.arange(n) % self.SAMPLE == 0) | start
        self.marked = kept[sa]
        self.at = np.cumsum(self.marked) - 1
        self.sample = sa[self.marked]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of the rows of phrases, all at once: their ranges of suffixes."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for j in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[:, j]
            lo, hi = self.first[c] + self.bwt.rank(c, lo), self.first[c] + self.bwt.rank(c, hi)
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of suffixes: walk back to a kept one."""
        out = np.zeros(len(rows), np.int64)
        row, idx, steps = rows.copy(), np.arange(len(rows)), 0
        while len(row):
            done = self.marked[row]
            out[idx[done]] = self.sample[self.at[row[done]]] + steps
            row, idx = row[~done], idx[~done]
            if len(row):
                sym, before = self.bwt.access_rank(row)
                row = self.first[sym] + before
                steps += 1
        return out
