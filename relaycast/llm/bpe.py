"""BPE encoding by speculation: longest-match proposes, pair checks verify, merging settles the rest.

For a new piece the longest vocabulary entries are taken from left to right. A sequence of tokens is the
encoding of its bytes exactly if every adjacent pair is the encoding of that pair's bytes, so all adjacent
pairs of all proposals are tested at once with numpy (walking down both tokens' merge trees along their
common border); only pieces with a failing pair are merged from their bytes in rank order, of long pieces
only spans around failing pairs, until both borders hold. Encoded pieces are kept in a bounded cache of the worker. Whole texts, no shuffle.

Defined cases: null and empty texts have no tokens and decode to the empty string; special tokens in a
text are recognised as the library does; repeated rows are encoded one by one; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import _text as X
from . import pieces as P
from ._agenda import Agenda

NEVER = 1 << 40
#: Failing pieces up to here are merged whole; of longer ones, only spans around failing pairs.
SHORT = 64


class Bpe:
    """Ranks, merge trees and pair checks of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, back = spec["model"], P.byte_alphabet()
        self.tokenizer = P.plain_tokenizer(path)
        vocab = model["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        # Tokens are numbered by order of making: bytes first, then merges by rank.
        order = {c: back[c] for c in back}
        self.left, self.right = list(range(256)), list(range(256))
        known: dict[int, int] = {}
        for a, b in pairs:
            made = order.setdefault(a + b, len(self.left))
            if made == len(self.left):
                self.left.append(order[a])
                self.right.append(order[b])
            known.setdefault(order[a] << 32 | order[b], made)
        self.left, self.right = np.array(self.left), np.array(self.right)
        self.pair = known
        self.keys = np.array(sorted(known), np.int64)
        self.made = np.array([known[k] for k in self.keys.tolist()], np.int64)
        width = np.ones(len(self.left), np.int64)
        for t in range(256, len(width)):
            width[t] = width[self.left[t]] + width[self.right[t]]
        self.agenda = Agenda(self.keys, self.made, self.made, width)
        self.id_of = self._ids(order, vocab)
        self.by_bytes = {bytes(back[c] for c in t): i for t, i in order.items()}
        self._trie()
        self.added = {t.content.encode(): i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.token_bytes = P.bytes_of_tokens(self.tokenizer)
        self.cutter, self.cache = P.Cutter(self.tokenizer), P.PieceCache(self.encode_pieces)

    @staticmethod
    def _ids(order: dict[str, int], vocab: dict[str, int]) -> np.ndarray:
        out = np.zeros(len(order), np.int32)
        for token, i in order.items():
            out[i] = vocab[token]
        return out

    def _trie(self):
        """All tokens' bytes as a trie: sorted edges (node, byte), where they lead, and the token that ends there."""
        edges: dict[int, int] = {}
        token = [-1]
        for string, t in self.by_bytes.items():
            node = 0
            for byte in string:
                to = edges.setdefault(node << 8 | byte, len(token))
                if to == len(token):
                    token.append(-1)
                node = to
            token[node] = t
        self.edge = np.array(sorted(edges), np.int64)
        self.leads = np.array([edges[k] for k in self.edge.tolist()], np.int64)
        self.ends = np.array(token, np.int64)

    def propose(self, data: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Longest vocabulary entries from left to right, a token of every piece at a time: tokens, pieces' counts."""
        who, begin, end = np.arange(len(at)), at.copy(), at + size
        owner, found = [], []
        while len(who):
            node, pos, stop = np.zeros(len(who), np.int64), begin[who], end[who]
            best, to, live = np.zeros(len(who), np.int64), pos.copy(), np.arange(len(who))
            while len(live):
                key = node[live] << 8 | data[pos[live]]
                place = np.minimum(np.searchsorted(self.edge, key), len(self.edge) - 1)
                ok = self.edge[place] == key
                live, below = live[ok], self.leads[place[ok]]
                node[live] = below
                pos[live] += 1
                token = self.ends[below]
                whole = live[token >= 0]
                best[whole], to[whole] = token[token >= 0], pos[whole]
                live = live[pos[live] < stop[live]]
            owner.append(who)
            found.append(best)
            begin[who] = to
            who = who[to < stop]
        of = np.concatenate(owner)
        return np.concatenate(found)[np.argsort(of, kind="stable")], np.bincount(of, minlength=len(at))

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the bytes of a + b gives exactly a, b."""
        a, b = a.copy(), b.copy()
        limit = np.full(len(a), NEVER, np.int64)
        ok, live = np.ones(len(a), bool), np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            key = x << 32 | y
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            joins = (self.keys[at] == key) & (self.made[at] < limit[live])
            ok[live[joins]] = False
            going = ~joins & (np.maximum(x, y) >= 256)
            live, x, y = live[going], x[going], y[going]
            newer_left = x > y  # undo whichever of the two was made last
            limit[live] = np.where(newer_left, x, y + 1)
            a[live] = np.where(newer_left, self.right[x], x)
            b[live] = np.where(newer_left, y, self.left[y])
        return ok

    def ranks(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """What merging x, y makes; NEVER if they don't merge."""
        key = x << 32 | y
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.made[at], NEVER)

    def merge_all(self, pieces: list[bytes]) -> list[list[int]]:
        """Exact merging in rank order, leftmost first, of pieces of one length, a merge each at a time."""
        n, width = len(pieces), len(pieces[0])
        token = np.frombuffer(b"".join(pieces), np.uint8).reshape(n, width).astype(np.int64)
        rank = self.ranks(token[:, :-1], token[:, 1:])
        out: list[list[int]] = [[]] * n
        who = np.arange(n)
        while True:
            best = rank.argmin(1) if rank.shape[1] else np.zeros(len(who), np.int64)
            made = rank[np.arange(len(who)), best] if rank.shape[1] else np.full(len(who), NEVER)
            done = made == NEVER
            for i, t in zip(who[done].tolist(), token[done].tolist(), strict=True):
                out[i] = t
            if done.all():
                return out
            who, token, rank, best, made = who[~done], token[~done], rank[~done], best[~done], made[~done]
            row, w = np.arange(len(who)), token.shape[1]
            token[row, best] = made
            token = token[np.arange(w)[None, :] != best[:, None] + 1].reshape(len(who), w - 1)
            rank = rank[np.arange(w - 1)[None, :] != best[:, None]].reshape(len(who), w - 2)
            left = np.flatnonzero(best > 0)
            rank[left, best[left] - 1] = self.ranks(token[left, best[left] - 1], token[left, best[left]])
            right = np.flatnonzero(best < w - 2)
            rank[right, best[right]] = self.ranks(token[right, best[right]], token[right, best[right] + 1])

    def encode_pieces(self, data: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces data[at : at + size] after one another, and how many each has."""
        # Long pieces are proposed in parts, all at once; the borders between them are tested like all others.
        parts = np.where(size > SHORT, -(-size // SHORT), 1)
        piece = np.repeat(np.arange(len(size)), parts)
        begin = (np.arange(len(piece)) - np.repeat(np.cumsum(parts) - parts, parts)) * SHORT
        flat, sizes = self.propose(data, at[piece] + begin, np.minimum(size[piece] - begin, np.where(parts[piece] > 1, SHORT, size[piece])))
        sizes = np.add.reduceat(sizes, np.cumsum(parts) - parts)
        ends = np.cumsum(sizes)
        start = ends - sizes
        inner = np.ones(len(flat), bool)
        inner[ends - 1] = False
        first = np.flatnonzero(inner)
        pairs, back = np.unique(flat[first] << 32 | flat[np.minimum(first + 1, len(flat) - 1)], return_inverse=True)
        wrong = first[~self.compatible(pairs >> 32, pairs & 0xFFFFFFFF)[back]]
        by_length: dict[int, list[int]] = {}
        failing = np.unique(np.searchsorted(ends, wrong, "right"))
        for i in failing[size[failing] <= SHORT].tolist():
            by_length.setdefault(int(size[i]), []).append(i)
        long = failing[size[failing] > SHORT]
        more, base = [flat], len(flat)
        for n, those in by_length.items():
            strings = [data[at[i] : at[i] + n].tobytes() for i in those]
            merged = self.merge_all(strings)
            sizes[those] = [len(t) for t in merged]
            start[those] = base + np.cumsum(sizes[those]) - sizes[those]
            more.append(np.array([t for m in merged for t in m], np.int64))
            base += len(more[-1])
        if len(long):
            doubt = np.zeros(len(flat), bool)
            doubt[wrong + 1] = True
            own = P.gather(np.arange(len(flat)), start[long], sizes[long])
            first = np.zeros(len(own), bool)
            first[np.cumsum(sizes[long]) - sizes[long]] = True
            fixed, many = self.agenda.repair(P.gather(data, at[long], size[long]).astype(np.int64), flat[own], first, doubt[own])
            start[long], sizes[long] = base + np.cumsum(many) - many, many
            more.append(fixed)
        ids = self.id_of[P.gather(np.concatenate(more), start, sizes)]
        for string, i in self.added.items():  # such a piece is the special token
            same = np.flatnonzero(size == len(string))
            same = [k for k in same.tolist() if data[at[k] : at[k] + len(string)].tobytes() == string] if len(same) else []
            for k in same:
                own = int(np.cumsum(sizes)[k] - sizes[k])
                ids = np.concatenate([ids[:own], np.array([i], ids.dtype), ids[own + sizes[k] :]])
                sizes[k] = 1
        return ids, sizes.astype(np.int32)

    def merge(self, piece: bytes) -> list[int]:
        """The same for one piece, with a heap."""
        return self.agenda.one(list(piece))

    def encode(self, text: X.Bytes) -> tuple[np.ndarray, np.ndarray]:
        return P.encode_chunk(text, self.cache, self.cutter)


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    """One encoder (and its cache) for each worker process."""
    return Bpe(path)


class Table:
    """Byte strings by id, for gathering many at once."""

    def __init__(self, strings: list[bytes]):
        self.size = np.array([len(s) for s in strings], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(strings), np.uint8)

    def join(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids' strings after one another, and the offsets of each id's."""
        size = self.size[ids]
        return P.gather(self.flat, self.start[ids], size), np.concatenate([[0], np.cumsum(size)])


@lru_cache(maxsize=2)
def _tables(path: str) -> tuple[Table, Table]:
    strings = load(path).token_bytes
    return Table(strings), Table([f"{i},".encode() for i in range(len(strings))])


def encode_decode(docs: DataFrame, path: str, digests: bool = False, row: bool = False) -> DataFrame:
    """doc_id, n_tokens and either ids and decoded text or, with ``digests``, their sha256."""

    def make():
        bpe = load(path)
        to_bytes, to_digits = _tables(path)

        def run(part):
            ids, offs = bpe.encode(X.text_bytes(part.column("text")))
            counts = pa.array(np.diff(offs).astype(np.int64))
            flat, at = to_bytes.join(ids)
            decoded = [flat[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(at[offs[:-1]], at[offs[1:]], strict=True)]
            if not digests:
                return [counts, pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(ids)), pa.array(decoded, pa.string())]
            digits, place = to_digits.join(ids)
            sha = [hashlib.sha256(digits[a : max(a, b - 1)]).hexdigest() for a, b in zip(place[offs[:-1]], place[offs[1:]], strict=True)]
            return [counts, pa.array(sha, pa.string()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in decoded], pa.string())]

        return run

    out = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "n_tokens long, ids array<int>, decoded string"
    return X.map_texts(docs, make, out, row=row, limit=P.CHUNK_BYTES)
