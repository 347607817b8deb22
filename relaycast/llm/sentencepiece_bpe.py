"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A text becomes symbols, one a character, with the space mark before it and for each space; the pair of adjacent
symbols whose joint string has the best score in the vocabulary merges first, the leftmost of equals. Two
characters that stand beside each other in no vocabulary entry are a border that no merge crosses, so texts are
cut there with numpy; distinct segments go through the agenda (``_agenda``) once and stay in a bounded cache of
the worker. What isn't in the vocabulary falls back to its bytes. In the Arrow batch where a segment is first met,
the sentencepiece library encodes it too, and the task fails unless every id is the same.

Defined cases: null and empty texts have the end id alone and decode to the empty string; control strings in a
text are ordinary text, as in the library; a literal space mark is a space; repeated rows are encoded one by
one; other columns are ignored; texts of any length are whole.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from sentencepiece import sentencepiece_model_pb2

from . import _text as X
from . import pieces as P
from ._agenda import Agenda
from .bpe import Table

#: The mark that stands for a space in vocabulary entries; inside this module it is a space again.
MARK = "▁"
_MARK_BYTES = np.frombuffer(MARK.encode(), np.uint8)
# Types of vocabulary entries.
NORMAL, UNKNOWN_TYPE, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


class SentencePieceBpe:
    """Symbols, pairs, borders and ids of a merge-type model file."""

    def __init__(self, path: str):
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        with open(path, "rb") as f:
            model = sentencepiece_model_pb2.ModelProto.FromString(f.read())
        norm, trained = model.normalizer_spec, model.trainer_spec
        types = {p.type for p in model.pieces}
        if trained.model_type != trained.BPE or types & {USER, UNUSED} or BYTE not in types:
            raise ValueError("only merge-type vocabularies with byte fallback and without user-defined or unused entries")
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or trained.treat_whitespace_as_suffix:
            raise ValueError("only vocabularies of unchanged texts with a space mark before them")
        self.end = trained.eos_id
        if any("\n" in p.piece for p in model.pieces if p.type == NORMAL):
            raise ValueError("line feeds bound what is checked against the library")
        normal = {p.piece.replace(MARK, " "): (i, p.score) for i, p in enumerate(model.pieces) if p.type == NORMAL}
        byte_ids = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.byte_id = np.array([byte_ids[b] for b in range(256)], np.int32)
        strings = sorted(set(normal) | {c for piece in normal for c in piece})
        number = {s: i + 1 for i, s in enumerate(strings)}  # 0 stands for all characters outside the vocabulary
        self.id_of = np.array([-1, *(normal[s][0] if s in normal else -1 for s in strings)], np.int32)
        order = {score: r for r, score in enumerate(sorted({s for _, s in normal.values()}, reverse=True))}
        pairs = [(number[p[:k]] << 32 | number[p[k:]], order[score], number[p]) for p, (_, score) in normal.items() for k in range(1, len(p)) if p[:k] in number and p[k:] in number]
        keys, rank, made = (np.array(x, np.int64) for x in zip(*sorted(pairs), strict=True))
        self.agenda = Agenda(keys, rank, made, np.array([1, *map(len, strings)], np.int64))
        # Borders: characters are numbered among those of the vocabulary.
        chars = [s for s in strings if len(s) == 1]
        self.char = np.zeros(0x110000, np.int32)
        self.char[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.symbol = np.array([0, *(number[c] for c in chars)], np.int64)
        self.many = len(chars) + 1
        self.joins = np.array(sorted({int(self.char[ord(a)]) * self.many + int(self.char[ord(b)]) for p in normal for a, b in zip(p, p[1:], strict=False)}), np.int64)
        self.near = np.zeros((128, 128), bool)
        own = self.char[:128].astype(np.int64)
        self.near[:] = self._joined(np.repeat(own, 128), np.tile(own, 128)).reshape(128, 128)
        self.cache = P.PieceCache(self.encode_segments)
        to_bytes = [b""] * len(model.pieces)
        for i, p in enumerate(model.pieces):
            if p.type == NORMAL:
                to_bytes[i] = p.piece.replace(MARK, " ").encode()
            elif p.type == BYTE:
                to_bytes[i] = bytes([int(p.piece[3:5], 16)])
            elif p.type == UNKNOWN_TYPE:
                to_bytes[i] = trained.unk_surface.encode()
        self.strings, self.digits = Table(to_bytes), Table([f"{i} ".encode() for i in range(len(model.pieces))])

    def _joined(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether two characters stand beside each other in an entry."""
        key = a * self.many + b
        return self.joins[np.minimum(np.searchsorted(self.joins, key), len(self.joins) - 1)] == key

    @staticmethod
    def marked(text: X.Bytes) -> X.Bytes:
        """Texts with a space before each that isn't empty, and a space for each literal mark."""
        data, offs = text.data, text.offs
        at = np.flatnonzero(data[:-2] == _MARK_BYTES[0]) if len(data) > 2 else np.zeros(0, np.int64)
        at = at[(data[at + 1] == _MARK_BYTES[1]) & (data[at + 2] == _MARK_BYTES[2])]
        if len(at):
            stay = np.ones(len(data), bool)
            stay[at + 1] = stay[at + 2] = False
            data = data.copy()
            data[at] = 32
            data, offs = data[stay], np.concatenate([[0], np.cumsum(stay)])[offs]
        filled = np.diff(offs) > 0
        return X.Bytes(np.insert(data, offs[:-1][filled], 32), offs + np.concatenate([[0], np.cumsum(filled)]))

    def cut(self, text: X.Bytes) -> P.Pieces:
        """Segments that no merge leaves."""
        data, offs = text.data, text.offs
        n = len(data)
        if not n:
            return P.Pieces(np.zeros(1, np.int64), np.zeros(len(offs), np.int64))
        edge = np.ones(n, bool)
        if data.max() < 128:
            edge[1:] = ~self.near[data[:-1], data[1:]]
        else:
            begin = np.flatnonzero((data & 0xC0) != 0x80)
            code = self._codes(data, begin)
            plain = code < 128
            both = plain[:-1] & plain[1:]
            joined = np.empty(len(begin) - 1, bool)
            joined[both] = self.near[code[:-1][both], code[1:][both]]
            joined[~both] = self._joined(self.char[code[:-1][~both]].astype(np.int64), self.char[code[1:][~both]].astype(np.int64))
            edge[:] = False
            edge[0] = True
            edge[begin[1:]] = ~joined
        edge[offs[:-1][np.diff(offs) > 0]] = True
        cuts = np.append(np.flatnonzero(edge), n)
        return P.Pieces(cuts, np.searchsorted(cuts, offs))

    @staticmethod
    def _codes(data: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Code points of the characters that begin there."""
        code = data[begin].astype(np.int64)
        for low, top, size in ((0xC0, 0xE0, 2), (0xE0, 0xF0, 3), (0xF0, 0x100, 4)):
            some = np.flatnonzero((data[begin] >= low) & (data[begin] < top))
            own = code[some] & (0xFF >> (size + 1))
            for j in range(1, size):
                own = own << 6 | (data[begin[some] + j] & 0x3F)
            code[some] = own
        return code

    def encode_segments(self, data: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the segments data[at : at + size] after one another, and how many each has."""
        flat, offs = P.gather(data, at, size), np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        begin = np.flatnonzero((flat & 0xC0) != 0x80)
        symbols = self.symbol[self.char[self._codes(flat, begin)]]
        token, many = self.agenda.merge(symbols, np.searchsorted(begin, offs))
        # Tokens that aren't entries are single characters: their bytes.
        first = np.cumsum(self.agenda.width[token]) - self.agenda.width[token]
        begin = np.append(begin, len(flat))
        ids = self.id_of[token]
        n_ids = np.where(ids < 0, begin[np.minimum(first + 1, len(begin) - 1)] - begin[first], 1)
        place = np.cumsum(n_ids) - n_ids
        out = np.empty(int(n_ids.sum()), np.int32)
        out[place[ids >= 0]] = ids[ids >= 0]
        other = np.flatnonzero(ids < 0)
        where = P.gather(np.arange(len(out)), place[other], n_ids[other])
        out[where] = self.byte_id[P.gather(flat, begin[first[other]], n_ids[other])]
        sizes = np.bincount(np.repeat(np.arange(len(many)), many), weights=n_ids, minlength=len(many)).astype(np.int32)
        self.check(flat, offs, out, sizes)
        return out, sizes

    def encode(self, text: X.Bytes) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts after one another, each with the end id, and offsets by text."""
        marked = self.marked(text)
        pieces = self.cut(marked)
        ends = np.arange(1, len(text.offs))
        if len(pieces.offs) < 2:
            return np.full(len(ends), self.end, np.int32), np.append(0, ends)
        coded = P.binaries(marked.data, pieces.offs).dictionary_encode()
        distinct = coded.dictionary
        at = np.frombuffer(distinct.buffers()[1], np.int64)[distinct.offset : distinct.offset + len(distinct) + 1]
        flat, start, size = self.cache.ids(np.frombuffer(distinct.buffers()[2], np.uint8), at[:-1], np.diff(at))
        which = np.asarray(coded.indices)
        own = size[which]
        offs = np.concatenate([[0], np.cumsum(own)])[pieces.docs]
        return np.insert(P.gather(flat, start[which], own), offs[1:], self.end), offs + np.append(0, ends)

    def decode(self, ids: np.ndarray, offs: np.ndarray) -> list[str]:
        """Each text's string: entries' strings and bytes, without the space before the text."""
        flat, at = self.strings.join(ids)
        found = [flat[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(at[offs[:-1]], at[offs[1:]], strict=True)]
        return [s[1:] if s[:1] == " " else s for s in found]

    def check(self, flat: np.ndarray, offs: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Raises if the library encodes a segment otherwise. Line feeds stand in no entry, so they part segments."""
        lead = np.array([10], np.uint8)
        text = np.insert(flat, offs[:-1], lead).tobytes().decode()
        given = np.array(self.library.encode(text), np.int32)[1:]  # without the mark before the text
        ends = np.cumsum(sizes)
        expected = np.insert(ids, ends - sizes, self.byte_id[10])
        if not np.array_equal(given, expected):
            at = int(np.flatnonzero(given[: len(expected)] != expected[: len(given)])[:1].sum())
            which = min(int(np.searchsorted(ends + np.arange(1, len(ends) + 1), at, "right")), len(ends) - 1)
            raise ValueError(f"the library encodes {flat[offs[which] : offs[which + 1]].tobytes()[:80]!r} otherwise")


@lru_cache(maxsize=2)
def load(path: str) -> SentencePieceBpe:
    """One encoder (and its cache) for each worker process."""
    return SentencePieceBpe(path)


def encode_decode(docs: DataFrame, path: str, digests: bool = False, row: bool = False) -> DataFrame:
    """doc_id, n_tokens and either ids and decoded text or, with ``digests``, their sha256."""

    def make():
        model = load(path)

        def run(part):
            ids, offs = model.encode(X.text_bytes(part.column("text")))
            counts, decoded = pa.array(np.diff(offs).astype(np.int64)), model.decode(ids, offs)
            if not digests:
                return [counts, pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(ids)), pa.array(decoded, pa.string())]
            digits, place = model.digits.join(ids)
            sha = [hashlib.sha256(digits[a : b - 1]).hexdigest() for a, b in zip(place[offs[:-1]], place[offs[1:]], strict=True)]
            return [counts, pa.array(sha, pa.string()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in decoded], pa.string())]

        return run

    out = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "n_tokens long, ids array<int>, decoded string"
    return X.map_texts(docs, make, out, row=row, limit=P.CHUNK_BYTES)
