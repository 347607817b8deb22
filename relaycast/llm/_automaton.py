"""Minimal acyclic automata over byte strings, built and searched with numpy, a level at a time.

States are the distinct right languages of a sorted word list; every edge carries how many words come before
those beneath it, so that the sum along an accepted path is the word's place in the sorted list (a minimal
perfect hash, both ways).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import pieces as P


class Strings:
    """Byte strings after one another."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        self.data, self.offs = data, offs

    def __len__(self) -> int:
        return len(self.offs) - 1

    @property
    def size(self) -> np.ndarray:
        return np.diff(self.offs)

    def take(self, which: np.ndarray) -> Strings:
        size = self.size[which]
        return Strings(P.gather(self.data, self.offs[:-1][which], size), np.concatenate([[0], np.cumsum(size)]))

    def reversed(self) -> Strings:
        """Each string read from its end."""
        size = self.size
        at = np.arange(len(self.data))
        return Strings(self.data[np.repeat(self.offs[:-1] + self.offs[1:] - 1, size) - at], self.offs)

    def order(self) -> np.ndarray:
        return pc.sort_indices(P.binaries(self.data, self.offs)).to_numpy().astype(np.int64)

    @staticmethod
    def of_latin(words: pa.Array) -> Strings:
        """UTF-8 words of characters up to U+00FF, a byte a character."""
        words = words.cast(pa.large_string())
        offs = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int64)
        raw = np.frombuffer(words.buffers()[2], np.uint8)[offs[0] : offs[-1]] if len(words) and offs[-1] > offs[0] else np.zeros(0, np.uint8)
        lead = raw >= 0xC2
        code = raw.copy()
        after = np.flatnonzero(lead) + 1
        code[after] = raw[after] + ((raw[after - 1] & 1) << 6)  # C2 xx stays, C3 xx is 64 further on
        return Strings(code[~lead], np.concatenate([[0], np.cumsum(~lead)])[offs - offs[0]])


class Automaton:
    """The minimal automaton of distinct strings in ascending order."""

    def __init__(self, words: Strings):
        parent, byte, final = self._trie(words)
        self._minimise(parent, byte, final)

    @staticmethod
    def _trie(words: Strings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Parents and bytes of all nodes but the root, a depth after the other, and which nodes end a word."""
        start, size = words.offs[:-1], words.size
        node, live, many = np.zeros(len(words), np.int64), np.arange(len(words)), 1
        parents, bytes_, depth = [], [], 0
        while len(live := live[size[live] > depth]):
            own, up = words.data[start[live] + depth], node[live]
            new = np.ones(len(live), bool)
            new[1:] = (own[1:] != own[:-1]) | (up[1:] != up[:-1])
            node[live] = many + np.cumsum(new) - 1
            parents.append(up[new])
            bytes_.append(own[new])
            many += int(new.sum())
            depth += 1
        final = np.zeros(many, bool)
        final[node] = True
        z = np.zeros(0, np.int64)
        return np.concatenate([z, *parents]), np.concatenate([z, *bytes_]), final

    def _minimise(self, parent: np.ndarray, byte: np.ndarray, final: np.ndarray) -> None:
        """Nodes of one height with equal ends and edges become one state, from the leaves up."""
        many = len(final)
        height = np.zeros(many, np.int64)
        first_child = np.searchsorted(parent, np.arange(many + 1))  # parents ascend: a node's edges stand together
        degree = np.diff(first_child)
        for nodes in self._depths(parent, many):
            inner = nodes[degree[nodes] > 0]
            if len(inner):
                low, top = first_child[inner[0]], first_child[inner[-1] + 1]
                height[inner] = 1 + np.maximum.reduceat(height[1 + low : 1 + top], first_child[inner] - low)
        state = np.zeros(many, np.int64)
        made = 0
        edge_state, edge_byte, edge_to, finals, degrees = [], [], [], [], []
        by_height = np.argsort(height, kind="stable")
        cuts = np.searchsorted(height[by_height], np.arange(height.max() + 2)) if many else np.zeros(1, np.int64)
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            nodes = by_height[lo:hi]
            for d in np.unique(degree[nodes]).tolist():
                own = nodes[degree[nodes] == d]
                edges = first_child[own][:, None] + np.arange(d)[None, :]
                sign = np.empty((len(own), d + 1), np.int64)
                sign[:, 0] = final[own]
                sign[:, 1:] = state[edges + 1] << 8 | byte[edges]
                if d <= 1:
                    _, first, which = np.unique(sign[:, -1] << 1 | sign[:, 0] if d else sign[:, 0], return_index=True, return_inverse=True)
                else:
                    order = np.lexsort(sign.T)
                    differs = np.ones(len(own), bool)
                    differs[1:] = (sign[order][1:] != sign[order][:-1]).any(1)
                    first, which = order[differs], np.empty(len(own), np.int64)
                    which[order] = np.cumsum(differs) - 1
                state[own] = made + which
                edge_state.append(np.repeat(made + np.arange(len(first)), d))
                edge_byte.append((sign[first, 1:] & 255).ravel())
                edge_to.append((sign[first, 1:] >> 8).ravel())
                finals.append(final[own[first]])
                degrees.append(np.full(len(first), d))
                made += len(first)
        self.root = int(state[0])
        self.final = np.concatenate(finals)
        self.degree = np.concatenate(degrees)
        self.first = np.cumsum(self.degree) - self.degree
        self.byte, self.to = np.concatenate(edge_byte), np.concatenate(edge_to)
        self.key = np.concatenate(edge_state) << 8 | self.byte
        # Words beneath a state, and before each edge: states are numbered by height, so those below are known.
        self.words = np.zeros(made, np.int64)
        self.before = np.zeros(len(self.to), np.int64)
        at = 0
        for part, d in zip(finals, degrees, strict=True):
            own, d = np.arange(at, at + len(part)), int(d[0])
            edges = self.first[own][:, None] + np.arange(d)[None, :]
            below = self.words[self.to[edges]]
            self.before[edges] = part[:, None] + np.cumsum(below, 1) - below
            self.words[own] = part + below.sum(1)
            at += len(part)

    @staticmethod
    def _depths(parent: np.ndarray, many: int):
        """Ranges of nodes of one depth, the deepest first."""
        cuts, lo, hi = [(0, 1)], 0, 1
        while hi < many:
            to = 1 + int(np.searchsorted(parent, hi))  # children of nodes below hi
            lo, hi = hi, to
            cuts.append((lo, hi))
        for lo, hi in reversed(cuts):
            yield np.arange(lo, hi)

    def step(self, state: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The edge that each state takes with its byte, and whether there is one."""
        if not len(self.key):
            return np.zeros(len(state), np.int64), np.zeros(len(state), bool)
        key = state << 8 | byte
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return at, self.key[at] == key

    def one_error(self, words: Strings, exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (word, number) of accepted strings one insertion, deletion or replacement away, all errors after
        the first ``exact`` bytes of the word; each pair once."""
        size, start = words.size, words.offs[:-1]
        who, state, number = np.arange(len(words)), np.full(len(words), self.root, np.int64), np.zeros(len(words), np.int64)
        for p in range(int(exact.max(initial=0))):
            more = exact[who] > p
            idle = (who[~more], state[~more], number[~more])
            who, state, number = who[more], state[more], number[more]
            at, ok = self.step(state, words.data[start[who] + p])
            who, state, number = who[ok], self.to[at[ok]], number[ok] + self.before[at[ok]]
            who, state, number = (np.concatenate(x) for x in zip(idle, (who, state, number), strict=True))
        pos = exact[who].astype(np.int64)
        rest = []  # (word, state, position, number) that must end without another error
        while len(who):
            inside = pos < size[who]
            rest.append((who[inside], state[inside], pos[inside] + 1, number[inside]))
            many = self.degree[state]
            i = np.repeat(np.arange(len(who)), many)
            edge = np.repeat(self.first[state] - (np.cumsum(many) - many), many) + np.arange(len(i))
            rest.append((who[i], self.to[edge], pos[i], number[i] + self.before[edge]))
            here = words.data[np.minimum(start[who] + pos, max(len(words.data) - 1, 0))]
            other = inside[i] & (self.byte[edge] != here[i])
            i, edge = i[other], edge[other]
            rest.append((who[i], self.to[edge], pos[i] + 1, number[i] + self.before[edge]))
            who, state, pos, number, here = who[inside], state[inside], pos[inside], number[inside], here[inside]
            at, ok = self.step(state, here)
            who, state, pos, number = who[ok], self.to[at[ok]], pos[ok] + 1, number[ok] + self.before[at[ok]]
        z = np.zeros(0, np.int64)
        who, state, pos, number = (np.concatenate([z, *x]) for x in zip(*rest, strict=True)) if rest else (z, z, z, z)
        found = []
        while len(who):
            done = pos == size[who]
            end = done & self.final[state]
            found.append(who[end] * np.int64(max(self.words[self.root], 1)) + number[end])
            who, state, pos, number = who[~done], state[~done], pos[~done], number[~done]
            at, ok = self.step(state, words.data[start[who] + pos])
            who, state, pos, number = who[ok], self.to[at[ok]], pos[ok] + 1, number[ok] + self.before[at[ok]]
        pairs = np.unique(np.concatenate([z, *found]))
        return pairs // max(int(self.words[self.root]), 1), pairs % max(int(self.words[self.root]), 1)

    def numbers(self, words: Strings) -> np.ndarray:
        """The number of each string, -1 for strings outside."""
        out, who = np.full(len(words), -1, np.int64), np.arange(len(words))
        state, number, p = np.full(len(words), self.root, np.int64), np.zeros(len(words), np.int64), 0
        while len(who):
            done = words.size[who] == p
            end = done & self.final[state]
            out[who[end]] = number[end]
            who, state, number = who[~done], state[~done], number[~done]
            at, ok = self.step(state, words.data[words.offs[:-1][who] + p])
            who, state, number = who[ok], self.to[at[ok]], number[ok] + self.before[at[ok]]
            p += 1
        return out
