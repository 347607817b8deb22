"""A score-ordered agenda of adjacent symbol pairs, for many strings at once.

The best pair of a string merges first, the leftmost of equals. Strings of one length are rows of a matrix, and
each step merges the best pair of every row. A sequence of tokens is the merging of its symbols exactly if every
two neighbours are the merging of theirs (before the first merge across a border, either side goes its own
way, and both tokens hold what then stands beside it). So a long string is put together from parts: only spans
around borders that aren't yet known to be right are merged again, wider each round, until every border is.
"""

from __future__ import annotations

import heapq

import numpy as np

from . import pieces as P

NEVER = 1 << 40
#: Symbols of a part of a long string; spans beyond the second bound are merged one by one, with a heap.
PART, WIDE = 24, 256
_CELLS = 1 << 21


class Agenda:
    """``keys`` (left << 32 | right, ascending), the ``rank`` of merging them (less is sooner) and what it ``made``;
    ``width`` is the number of first symbols in each symbol."""

    def __init__(self, keys: np.ndarray, rank: np.ndarray, made: np.ndarray, width: np.ndarray):
        self.keys, self.rank, self.made, self.width = keys, rank, made, width
        self._pairs: dict[int, tuple[int, int]] | None = None

    def look(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the pairs are among ``keys``, and their ranks; NEVER for those that don't merge."""
        key = x << 32 | y
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return at, np.where(self.keys[at] == key, self.rank[at], NEVER)

    def rows(self, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All rows of a matrix of symbols, merged: tokens after one another, and how many of each row."""
        out, many = [], np.zeros(len(token), np.int64)
        for lo in range(0, len(token), step := max(1, _CELLS // max(token.shape[1], 1))):
            found, of = self._rows(token[lo : lo + step])
            many[lo : lo + step] = np.bincount(of, minlength=min(step, len(token) - lo))
            out.append(found[np.argsort(of, kind="stable")])
        return np.concatenate([np.zeros(0, np.int64), *out]), many

    def _rows(self, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rank = self.look(token[:, :-1], token[:, 1:])[1]
        who, out, of = np.arange(len(token)), [], []
        while len(who):
            w = token.shape[1]
            if w == 1:
                done = np.ones(len(who), bool)
            else:
                best = rank.argmin(1)
                done = rank[np.arange(len(who)), best] == NEVER
            out.append(token[done].ravel())
            of.append(np.repeat(who[done], w))
            if done.all():
                break
            who, token, rank, best = who[~done], token[~done], rank[~done], best[~done]
            row = np.arange(len(who))
            token[row, best] = self.made[self.look(token[row, best], token[row, best + 1])[0]]
            token = token[np.arange(w)[None, :] != best[:, None] + 1].reshape(len(who), w - 1)
            rank = rank[np.arange(w - 1)[None, :] != best[:, None]].reshape(len(who), w - 2)
            left = np.flatnonzero(best > 0)
            rank[left, best[left] - 1] = self.look(token[left, best[left] - 1], token[left, best[left]])[1]
            right = np.flatnonzero(best < w - 2)
            rank[right, best[right]] = self.look(token[right, best[right]], token[right, best[right] + 1])[1]
        return np.concatenate([np.zeros(0, np.int64), *out]), np.concatenate([np.zeros(0, np.int64), *of])

    def one(self, token: list[int]) -> list[int]:
        """The same for one string, with a heap."""
        if self._pairs is None:
            self._pairs = {k: (r, m) for k, r, m in zip(self.keys.tolist(), self.rank.tolist(), self.made.tolist(), strict=True)}
        pairs, n = self._pairs, len(token)
        after, before, alive = [*range(1, n), -1], [-1, *range(n - 1)], [True] * n
        heap = [(p[0], i, token[i], token[i + 1], p[1]) for i in range(n - 1) if (p := pairs.get(token[i] << 32 | token[i + 1]))]
        heapq.heapify(heap)
        while heap:
            _, i, x, y, made = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j < 0 or token[i] != x or token[j] != y:
                continue
            token[i], alive[j], after[i] = made, False, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for p, q in ((before[i], i), (i, after[i])):
                if p >= 0 and q >= 0 and (found := pairs.get(token[p] << 32 | token[q])):
                    heapq.heappush(heap, (found[0], p, token[p], token[q], found[1]))
        return [t for t, a in zip(token, alive, strict=True) if a]

    def spans(self, symbols: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slices of ``symbols`` (none empty), each merged as a whole, grouped by length."""
        many, at = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        out, base = [], 0
        order = np.argsort(size, kind="stable")
        cuts = np.flatnonzero(np.diff(size[order], prepend=-1))
        for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)], strict=True):
            who, n = order[lo:hi], int(size[order[lo]])
            if n <= WIDE:
                found, own = self.rows(symbols[start[who][:, None] + np.arange(n)[None, :]])
            else:
                merged = [self.one(symbols[a : a + n].tolist()) for a in start[who].tolist()]
                found, own = np.array([t for m in merged for t in m], np.int64), np.array([len(m) for m in merged])
            many[who], at[who] = own, base + np.cumsum(own) - own
            out.append(found)
            base += len(found)
        return P.gather(np.concatenate([np.zeros(0, np.int64), *out]), at, many), many

    def merge(self, symbols: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Strings of any length (none empty): tokens after one another, and how many of each string."""
        size = np.diff(offs)
        parts = -(-size // PART)
        owner = np.repeat(np.arange(len(size)), parts)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
        start = offs[:-1][owner] + nth * PART
        token, many = self.spans(symbols, start, np.minimum(PART, offs[1:][owner] - start))
        if len(owner) == len(size):
            return token, many
        at = np.cumsum(many) - many
        first, doubt = np.zeros(len(token), bool), np.zeros(len(token), bool)
        first[at[nth == 0]] = True
        doubt[at[nth > 0]] = True
        return self.repair(symbols, token, first, doubt)

    def repair(self, symbols: np.ndarray, token: np.ndarray, first: np.ndarray, doubt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens made right: ``first`` marks those that begin a string, ``doubt`` those whose border with the token
        before isn't known to be right. Returns tokens, and how many each string has."""
        rounds = 0
        while doubt.any():
            wider = 0 if rounds < 3 else 1 << (rounds - 3)
            rounds += 1
            n = len(token)
            begin = np.concatenate([[0], np.cumsum(self.width[token])])
            heads = np.append(np.flatnonzero(first), n)
            j = np.flatnonzero(doubt)
            string = np.searchsorted(heads, j, "right") - 1
            lo, hi = np.maximum(j - 1 - wider, heads[string]), np.minimum(j + 1 + wider, heads[string + 1])
            apart = np.ones(len(j), bool)
            apart[1:] = lo[1:] >= np.maximum.accumulate(hi)[:-1]
            lo, hi = lo[apart], np.maximum.reduceat(hi, np.flatnonzero(apart))
            made, many = self.spans(symbols, begin[lo], begin[hi] - begin[lo])
            count = np.ones(n, np.int64)
            inside = np.zeros(n + 1, np.int64)
            inside[lo] += 1
            np.add.at(inside, hi, -1)
            inside = np.cumsum(inside[:-1]) > 0
            count[inside] = 0
            count[lo] = many
            place = np.cumsum(count) - count
            total = int(count.sum())
            fresh, begins, left = np.empty(total, np.int64), np.zeros(total, bool), np.zeros(total, bool)
            fresh[place[~inside]] = token[~inside]
            ends = np.cumsum(many)
            fresh[np.repeat(place[lo] - (ends - many), many) + np.arange(len(made))] = made
            begins[place[first]] = True  # a span begins no later than its string's first token
            changed = (made[ends - many] != token[lo]) & ~first[lo]
            left[place[lo[changed]]] = True
            changed = (made[ends - 1] != token[hi - 1]) & (hi < n)
            after = hi[changed]
            after = after[~first[after]]
            left[place[after]] = True
            token, first, doubt = fresh, begins, left
        heads = np.append(np.flatnonzero(first), len(token))
        return token, np.diff(heads)
