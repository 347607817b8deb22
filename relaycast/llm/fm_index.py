"""An FM-index over word symbols, vectorised with numpy.

A shard is a sequence of symbols in which 0 separates runs. Suffixes are sorted completely (packed first
keys, then prefix doubling on what is still equal), the Burrows-Wheeler transform is kept as a wavelet
matrix, and every ``sample``-th suffix position and each run's first one are stored. Patterns are searched
backwards, all at once; occurrences are located by walking the LF mapping to a stored position.
"""

from __future__ import annotations

import numpy as np


def suffix_array(sym: np.ndarray, bits: int) -> np.ndarray:
    """Order of all suffixes; separators (0) differ from one another, the earlier one being smaller."""
    n, width = len(sym), max(1, 63 // bits)
    key, open_ = np.zeros(n, np.int64), np.ones(n, bool)
    for j in range(width):
        s = np.zeros(n, np.int64)
        s[: max(n - j, 0)] = sym[j:]
        s[~open_] = 0
        key = (key << bits) | s
        open_ &= s > 0
    sa = np.argsort(key, kind="stable")
    sorted_key = key[sa]
    new = np.ones(n, bool)
    new[1:] = sorted_key[1:] != sorted_key[:-1]
    new |= ~open_[sa]  # ends at a separator: text order, which the stable sort kept, decides
    place = np.arange(n)
    group = np.maximum.accumulate(np.where(new, place, 0))
    rank = np.empty(n, np.int64)
    rank[sa] = group
    step = width
    while True:
        active = np.flatnonzero(~(new & np.append(new[1:], True)))
        if not len(active):
            return sa
        pos, own = sa[active], group[active]
        second = rank[pos + step]
        order = np.lexsort((second, own))
        pos, second = pos[order], second[order]
        fresh = np.ones(len(active), bool)
        fresh[1:] = (own[1:] != own[:-1]) | (second[1:] != second[:-1])
        sa[active], new[active] = pos, fresh
        group[active] = np.maximum.accumulate(np.where(fresh, active, 0))
        rank[pos] = group[active]
        step *= 2


class WaveletMatrix:
    """Rank of a symbol before a place, and symbol plus rank at a place, in one step a bit."""

    def __init__(self, values: np.ndarray, bits: int):
        self.bits, self.zeros, self.before = bits, [], []
        v = values
        for level in range(bits - 1, -1, -1):
            one = (v >> level & 1).astype(bool)
            zero_before = np.zeros(len(v) + 1, np.int32)
            np.cumsum(~one, out=zero_before[1:])
            self.before.append(zero_before)
            self.zeros.append(int(zero_before[-1]))
            v = np.concatenate([v[~one], v[one]])

    def descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, (before, zeros) in enumerate(zip(self.before, self.zeros, strict=True)):
            z = before[at]
            at = np.where(symbol >> (self.bits - 1 - k) & 1, zeros + at - z, z)
        return at

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols at places, and where these places end up below."""
        symbol = np.zeros(len(at), np.int64)
        for before, zeros in zip(self.before, self.zeros, strict=True):
            z = before[at]
            one = before[at + 1] == z
            symbol = (symbol << 1) | one
            at = np.where(one, zeros + at - z, z)
        return symbol, at


class FMIndex:
    """Counts and locates patterns in a sequence of symbols 0..n_symbols, 0 being the separator (also last)."""

    def __init__(self, sym: np.ndarray, n_symbols: int, sample: int = 8):
        self.bits = max(1, int(n_symbols).bit_length())
        sa = suffix_array(sym, self.bits)
        bwt = sym[sa - 1]  # sa == 0 takes the last symbol, a separator
        self.tree = WaveletMatrix(bwt, self.bits)
        counts = np.bincount(sym, minlength=n_symbols + 1)
        self.first = np.concatenate([[0], np.cumsum(counts)])  # of the suffixes that begin with a symbol
        self.base = self.tree.descend(np.arange(n_symbols + 1), np.zeros(n_symbols + 1, np.int64))
        stored = (sa % sample == 0) | (bwt == 0)
        self.rank_of_stored = np.concatenate([[0], np.cumsum(stored)]).astype(np.int32)
        self.stored = sa[stored]

    def _occurrences(self, symbol: np.ndarray, before: np.ndarray) -> np.ndarray:
        return self.tree.descend(symbol, before) - self.base[symbol]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix interval [from, to) of each row of ``patterns`` (all of one length, symbols over 0)."""
        n = len(patterns)
        lo, hi = np.zeros(n, np.int64), np.zeros(n, np.int64)
        live = np.arange(n)
        last = patterns[:, -1]
        a, b = self.first[last], self.first[last + 1]
        for j in range(patterns.shape[1] - 2, -1, -1):
            keep = b > a
            live, a, b = live[keep], a[keep], b[keep]
            c = patterns[live, j]
            a, b = self.first[c] + self._occurrences(c, a), self.first[c] + self._occurrences(c, b)
        lo[live], hi[live] = a, np.maximum(a, b)
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Sequence positions of suffixes, by LF steps to the nearest stored position."""
        out, steps = np.empty(len(rows), np.int64), 0
        todo, rows = np.arange(len(rows)), rows.astype(np.int64)
        while len(todo):
            r = self.rank_of_stored[rows]
            found = self.rank_of_stored[rows + 1] > r
            out[todo[found]] = self.stored[r[found]] + steps
            todo, rows = todo[~found], rows[~found]
            c, below = self.tree.access(rows)
            rows = self.first[c] + below - self.base[c]
            steps += 1
        return out
