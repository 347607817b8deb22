"""Byte-level BPE pre-tokenisation, vectorised, and a cache of the pieces' token ids.

A text is cut into pieces (contractions, words with a leading space, numbers, other signs, white space) by
class boundaries found with numpy over a whole chunk. A character's class is asked of the tokenizers library's
own pre-tokenizer the first time a worker meets it, so results never depend on whose Unicode tables are newer,
and every script takes the same path. Special tokens' strings bound the text on either side of them, as they
do in the library.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from . import _text as X

# Classes of characters.
SPACE, LETTER, NUMBER, SIGN, UNKNOWN, SPECIAL = range(6)

#: Bytes of text that are cut and encoded at once; a worker needs about thirty times as much.
CHUNK_BYTES = 2 << 20


class Pieces(NamedTuple):
    offs: np.ndarray  # byte offsets of pieces, one more than there are
    docs: np.ndarray  # of each document's pieces, one more than there are


class Cutter:
    """Cuts texts as a tokenizer's pre-tokenizer does."""

    def __init__(self, tokenizer: Tokenizer):
        self.ask = tokenizer.pre_tokenizer.pre_tokenize_str
        self.special = sorted((t.content.encode() for t in tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.kind = np.full(0x110000, UNKNOWN, np.uint8)
        self._learn(np.arange(128))
        self.kind[32] = SPACE  # it joins the character after it, so asking does not tell
        self.ascii = np.append(self.kind[:128], np.full(128, UNKNOWN, np.uint8))

    def _learn(self, codes: np.ndarray) -> None:
        for code in codes.tolist():
            c = chr(code)
            beside = self.ask(f"a{c}1")
            if len(beside) == 2:
                self.kind[code] = LETTER if beside[0][1][1] == 2 else NUMBER
            else:
                self.kind[code] = SIGN if len(self.ask(f"!{c}!")) == 1 else SPACE

    def _classes(self, codes: np.ndarray) -> np.ndarray:
        found = self.kind[codes]
        if (found == UNKNOWN).any():
            self._learn(np.unique(codes[found == UNKNOWN]))
            found = self.kind[codes]
        return found

    def _special_spans(self, text: X.Bytes) -> list[tuple[int, int]]:
        """Leftmost, longest occurrences inside one text."""
        raw = text.data.tobytes() if self.special else b""
        if not any(s in raw for s in self.special):
            return []
        pattern, out = re.compile(b"|".join(map(re.escape, self.special))), []
        for d in sorted({int(np.searchsorted(text.offs, m.start(), "right")) - 1 for s in self.special for m in re.finditer(re.escape(s), raw)}):
            at = int(text.offs[d])
            out += [(at + m.start(), at + m.end()) for m in pattern.finditer(raw[at : int(text.offs[d + 1])])]
        return out

    def cut(self, text: X.Bytes) -> Pieces:
        data, offs = text.data, text.offs
        n = len(data)
        if not n:
            return Pieces(np.zeros(1, np.int64), np.zeros(len(offs), np.int64))
        kind = self.ascii[data]
        high = np.flatnonzero(data >= 0xC0)
        if len(high):
            lead = data[high]
            for low, top, size in ((0xC0, 0xE0, 2), (0xE0, 0xF0, 3), (0xF0, 0x100, 4)):
                at = high[(lead >= low) & (lead < top)]
                if len(at):
                    code = (data[at] & (0xFF >> (size + 1))).astype(np.int64)
                    for j in range(1, size):
                        code = code << 6 | (data[at + j] & 0x3F)
                    own = self._classes(code)
                    for j in range(size):
                        kind[at + j] = own
        doc_edge = np.zeros(n + 1, bool)
        doc_edge[offs] = True
        for a, b in self._special_spans(text):
            doc_edge[a] = doc_edge[b] = True
            kind[a:b] = SPECIAL
        run = np.ones(n, bool)  # starts of runs of one class
        run[1:] = kind[1:] != kind[:-1]
        run |= doc_edge[:-1]
        blank = data == 32
        edge = run.copy()
        # A space just before a run of another class in the same text belongs to that run.
        after_space = np.zeros(n, bool)
        after_space[1:] = run[1:] & blank[:-1] & (kind[1:] != SPACE) & ~doc_edge[1:-1]
        edge &= ~after_space
        # White space before something else gives up its last character.
        before = np.flatnonzero(run & (kind != SPACE))
        before = before[before > 0]
        before = before[(kind[before - 1] == SPACE) & ~doc_edge[before]] - 1
        for _ in range(2):  # back to the first byte of that character
            before = before - ((data[before] & 0xC0) == 0x80)
        edge[before] = True
        # Contractions: an apostrophe that begins a piece.
        mark = np.flatnonzero(edge & (data == 39))
        mark = mark[mark + 1 < n]
        mark = mark[(kind[mark + 1] == LETTER) & ~doc_edge[mark + 1]]
        if len(mark):
            one = data[mark + 1]
            two = data[np.minimum(mark + 2, n - 1)]
            inside = (mark + 2 < n) & ~doc_edge[np.minimum(mark + 2, n)]
            short = np.isin(one, [115, 116, 109, 100])  # s t m d
            long = inside & (((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108))  # re ve ll
            for at, size in ((mark[short], 2), (mark[long & ~short], 3)):
                edge[at + 1] = False
                rest = at + size
                edge[rest[rest < n]] = True
        edge |= doc_edge[:-1]
        cuts = np.append(np.flatnonzero(edge), n)
        return Pieces(cuts, np.searchsorted(cuts, offs))


def _same_bytes(a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether slices of one size (not 0) hold equal bytes."""
    if not len(size):
        return np.zeros(0, bool)
    return np.logical_and.reduceat(gather(a, a_at, size) == gather(b, b_at, size), np.cumsum(size) - size)


class _Table:
    """Pieces under their 64-bit hashes, with bytes and ids in growing arrays."""

    def __init__(self):
        self.key, self.row = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.n = self.n_bytes = self.n_ids = 0
        self.bytes, self.ids = np.zeros(1 << 16, np.uint8), np.zeros(1 << 14, np.int32)
        self.at, self.size, self.id_at, self.id_size = (np.zeros(1 << 12, t) for t in (np.int64, np.int32, np.int64, np.int32))

    def find(self, h, data, at, size) -> np.ndarray:
        """Rows of the pieces, -1 for pieces that are not here."""
        out = np.full(len(h), -1, np.int64)
        if not len(self.key):
            return out
        place = np.minimum(np.searchsorted(self.key, h), len(self.key) - 1)
        row = self.row[place].astype(np.int64)
        hit = np.flatnonzero((self.key[place] == h) & (self.size[row] == size))
        hit = hit[_same_bytes(self.bytes, self.at[row[hit]], data, at[hit], size[hit])]
        out[hit] = row[hit]
        return out

    @staticmethod
    def _room(a: np.ndarray, need: int) -> np.ndarray:
        return a if need <= len(a) else np.concatenate([a, np.zeros(max(need - len(a), len(a) // 2), a.dtype)])

    def add(self, h, data, at, size, ids, id_size) -> None:
        """New pieces; one whose hash is taken by another piece stays out."""
        own, first = np.unique(h, return_index=True)
        if len(self.key):
            place = np.minimum(np.searchsorted(self.key, own), len(self.key) - 1)
            free = self.key[place] != own
            own, first = own[free], first[free]
        size, many = size[first], id_size[first]
        flat, flat_ids = gather(data, at[first], size), gather(ids, (np.cumsum(id_size) - id_size)[first], many)
        k = len(own)
        for name in ("at", "size", "id_at", "id_size"):
            setattr(self, name, self._room(getattr(self, name), self.n + k))
        self.bytes, self.ids = self._room(self.bytes, self.n_bytes + len(flat)), self._room(self.ids, self.n_ids + len(flat_ids))
        new = slice(self.n, self.n + k)
        self.at[new], self.size[new] = self.n_bytes + np.cumsum(size) - size, size
        self.id_at[new], self.id_size[new] = self.n_ids + np.cumsum(many) - many, many
        self.bytes[self.n_bytes : self.n_bytes + len(flat)] = flat
        self.ids[self.n_ids : self.n_ids + len(flat_ids)] = flat_ids
        place = np.searchsorted(self.key, own)
        self.key, self.row = np.insert(self.key, place, own), np.insert(self.row, place, np.arange(self.n, self.n + k, dtype=np.int32))
        self.n, self.n_bytes, self.n_ids = self.n + k, self.n_bytes + len(flat), self.n_ids + len(flat_ids)


class PieceCache:
    """Token ids of pieces, looked up by hash and verified by bytes.

    Two generations of at most about ``limit`` pieces together (some 50 bytes each): a full one becomes the old
    one, from which pieces that are met again move on; the rest goes with it.
    """

    def __init__(self, encode, limit: int = 1 << 20):
        self.encode, self.limit = encode, limit
        self.young, self.old = _Table(), _Table()

    def ids(self, data: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct pieces data[at : at + size]: a flat array, and each piece's start and size in it."""
        h = X.hash_words(X.Words(data, at, at + size, at))
        if self.young.n + len(h) > self.limit // 2:
            self.young, self.old = _Table(), self.young
        row = self.young.find(h, data, at, size)
        known, rest = np.flatnonzero(row >= 0), np.flatnonzero(row < 0)
        sizes, starts = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
        parts, base = [], 0

        def put(who, ids, many):
            nonlocal base
            sizes[who], starts[who] = many, base + np.cumsum(many) - many
            parts.append(ids)
            base += len(ids)

        put(known, gather(self.young.ids, self.young.id_at[row[known]], self.young.id_size[row[known]]), self.young.id_size[row[known]])
        row = self.old.find(h[rest], data, at[rest], size[rest])
        again, new = rest[row >= 0], rest[row < 0]
        for who, got in ((again, lambda: (gather(self.old.ids, self.old.id_at[row[row >= 0]], self.old.id_size[row[row >= 0]]), self.old.id_size[row[row >= 0]])), (new, lambda: self.encode(data, at[new], size[new]))):
            if len(who):
                ids, many = got()
                put(who, ids, many)
                self.young.add(h[who], data, at[who], size[who], ids, many)
        return np.concatenate(parts), starts, sizes


def gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The slices flat[start : start + size] after one another."""
    total = int(size.sum())
    if not total:
        return flat[:0]
    shift = start - (np.cumsum(size) - size)
    return flat[np.repeat(shift, size) + np.arange(total)]


def binaries(data: np.ndarray, offs: np.ndarray) -> pa.LargeBinaryArray:
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offs) - 1, [None, pa.py_buffer(offs.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


def encode_chunk(text: X.Bytes, cache: PieceCache, cutter: Cutter) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts after one another, and offsets by document."""
    pieces = cutter.cut(text)
    if len(pieces.offs) < 2:
        return np.zeros(0, np.int32), np.zeros(len(text.offs), np.int64)
    coded = binaries(text.data, pieces.offs).dictionary_encode()
    distinct = coded.dictionary
    at = np.frombuffer(distinct.buffers()[1], np.int64)[distinct.offset : distinct.offset + len(distinct) + 1]
    flat, start, size = cache.ids(np.frombuffer(distinct.buffers()[2], np.uint8), at[:-1], np.diff(at))
    which = np.asarray(coded.indices)
    own = size[which]
    return gather(flat, start[which], own), np.concatenate([[0], np.cumsum(own)])[pieces.docs]


def plain_tokenizer(path: str) -> Tokenizer:
    """The file's tokenizer without truncation and padding."""
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def library_encoder(tokenizer: Tokenizer, token_bytes: list[bytes]):
    """Encodes many pieces at once with the library.

    Pieces of the form space + letters are cut alike when they stand after one another, so a hundred of them
    make one call; the ids are dealt back by their bytes.
    """
    lengths = np.array([len(b) for b in token_bytes], np.int64)

    def encode(data: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        pieces = binaries(gather(data, at, size), np.concatenate([[0], np.cumsum(size)])).to_pylist()
        texts = [p.decode() for p in pieces]
        word = [t[0] == " " and t[1:].isalpha() for t in texts]
        joins, alone = [i for i, w in enumerate(word) if w], [i for i, w in enumerate(word) if not w]
        groups = [joins[i : i + 100] for i in range(0, len(joins), 100)]
        found = tokenizer.encode_batch_fast(["".join([texts[i] for i in g]) for g in groups] + [texts[i] for i in alone], add_special_tokens=False)
        of_joined = np.concatenate([np.zeros(0, np.int32), *(np.array(e.ids, np.int32) for e in found[: len(groups)])]).astype(np.int32)
        ends = np.cumsum([len(pieces[i]) for i in joins])
        of_alone = [e.ids for e in found[len(groups) :]]
        sizes = np.zeros(len(pieces), np.int64)
        starts = np.zeros(len(pieces), np.int64)
        if joins:
            to = np.searchsorted(np.cumsum(lengths[of_joined]), ends) + 1
            sizes[joins] = np.diff(to, prepend=0)
            starts[joins] = to - sizes[joins]
        if alone:
            many = np.array([len(x) for x in of_alone], np.int64)
            sizes[alone] = many
            starts[alone] = len(of_joined) + np.cumsum(many) - many
        flat = np.concatenate([of_joined, np.array([i for x in of_alone for i in x], np.int32)])
        return gather(flat, starts, sizes), sizes.astype(np.int32)

    return encode


def byte_alphabet() -> dict[str, int]:
    """Byte-level BPE's printable stand-ins: printable Latin-1 bytes stand for themselves, the rest follow from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def bytes_of_tokens(tokenizer: Tokenizer) -> list[bytes]:
    """By id: the bytes a token decodes to (special tokens: their string's)."""
    vocab, back = tokenizer.get_vocab(with_added_tokens=True), byte_alphabet()
    out = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        out[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
    return out
