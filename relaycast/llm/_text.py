"""Vectorised text primitives on Arrow buffers: words, word hashes, per-document offsets.

Everything works on the UTF-8 bytes of a whole batch at once, so cost is a few numpy passes a byte and
memory is a small multiple of the batch. Batches are cut to ``CHUNK_BYTES`` of text; one longer text is
a chunk of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 4 << 20
_BLOCK = 1 << 20
_MULT = 0x9E3779B97F4A7C15 | 1
_M64 = (1 << 64) - 1

ASCII_SPACE = bytes([9, 10, 11, 12, 13, 32])


def _table(is_word) -> np.ndarray:
    return np.array([is_word(b) for b in range(256)], dtype=bool)


#: Words are runs of anything but ASCII white space.
SPACED = _table(lambda b: b not in ASCII_SPACE)
#: Words are runs of digits, letters a-z and every character from U+0080.
ALNUM = _table(lambda b: b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A)
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], dtype=np.uint8)

_BYTE_VALUES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.int64).astype(np.uint64) | np.uint64(1)
_powers: list[np.ndarray] = []


def _power_tables() -> tuple[np.ndarray, np.ndarray]:
    if not _powers:
        for base in (_MULT, pow(_MULT, -1, 1 << 64)):
            p = np.full(_BLOCK + 1, base, dtype=np.uint64)
            p[0] = 1
            with np.errstate(over="ignore"):
                np.multiply.accumulate(p, out=p)
            _powers.append(p)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads every bit of a uint64 over all others."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Bytes(NamedTuple):
    data: np.ndarray  # uint8, all texts after one another
    offs: np.ndarray  # int64, len(texts) + 1


class Words(NamedTuple):
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    offs: np.ndarray  # of each document's words, len(texts) + 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offs)

    def docs(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offs) - 1), self.counts)


def text_bytes(texts: pa.Array) -> Bytes:
    """The bytes of a string column; a null counts as empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offs = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = texts.buffers()[2] if len(texts) else None
    data = np.frombuffer(raw, np.uint8)[offs[0] : offs[-1]] if raw is not None and offs[-1] > offs[0] else np.zeros(0, np.uint8)
    return Bytes(data, offs - offs[0])


def chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most ``limit`` bytes of text each, or one row."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, at = np.cumsum(sizes), 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


def find_words(text: Bytes, is_word: np.ndarray = SPACED, lower: bool = False) -> Words:
    """Starts and ends of all words; none crosses from one text into the next."""
    data = LOWER[text.data] if lower else text.data
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return Words(data, z, z, np.zeros(len(text.offs), np.int64))
    w = is_word[data]
    first, last = w.copy(), w.copy()
    first[1:] &= ~w[:-1]
    last[:-1] &= ~w[1:]
    cut = text.offs[:-1]
    cut = cut[(cut > 0) & (cut < n)]
    first[cut] = w[cut]
    last[cut - 1] = w[cut - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return Words(data, starts, ends, np.searchsorted(starts, text.offs))


def hash_words(words: Words) -> np.ndarray:
    """A 64-bit hash of each word's bytes, the same on every machine (tabulated polynomial, then mixed)."""
    power, inverse = _power_tables()
    out = np.empty(len(words.starts), np.uint64)
    at, n = 0, len(words.starts)
    with np.errstate(over="ignore"):
        while at < n:
            base = words.starts[at]
            to = int(np.searchsorted(words.ends, base + _BLOCK, "right"))
            if to <= at:  # one word longer than a block
                out[at] = _long_word(words.data[base : words.ends[at]], power)
                at += 1
                continue
            part = _BYTE_VALUES[words.data[base : words.ends[to - 1]]]
            part *= power[: len(part)]
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(part, out=sums[1:])
            s = words.starts[at:to] - base
            out[at:to] = (sums[words.ends[at:to] - base] - sums[s]) * inverse[s]
            at = to
        return mix(out + (words.ends - words.starts).astype(np.uint64))


def _long_word(data: np.ndarray, power: np.ndarray) -> np.uint64:
    total, shift = 0, 1
    step = pow(_MULT, _BLOCK, 1 << 64)
    for i in range(0, len(data), _BLOCK):
        part = _BYTE_VALUES[data[i : i + _BLOCK]] * power[: len(data[i : i + _BLOCK])]
        total = (total + int(part.sum(dtype=np.uint64)) * shift) & _M64
        shift = shift * step & _M64
    return np.uint64(total)


def windows(counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First word (index in the batch) and document of every window of ``size`` words, document by document."""
    many = np.maximum(counts - size + 1, 0)
    base = np.concatenate([[0], np.cumsum(counts)[:-1]]) if len(counts) else np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(counts)), many)
    first = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + base[doc]
    return first.astype(np.int64), doc


def combine(h: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` word hashes from each place in ``first``; order counts. Long runs come from prefix sums."""
    with np.errstate(over="ignore"):
        if size > 8:
            return mix(_rolling(h, size)[first]) if len(first) else np.zeros(0, np.uint64)
        out = np.zeros(len(first), np.uint64)
        for j in range(size):
            out = (out * np.uint64(0xD6E8FEB86659FD93)) + h[first + j]
        return mix(out)


def _rolling(h: np.ndarray, size: int) -> np.ndarray:
    """Polynomial hashes of all runs of ``size`` values (h's values are random 64-bit ones)."""
    power, inverse = _power_tables()
    n, step = len(h) - size + 1, _BLOCK - size
    out = np.empty(max(n, 0), np.uint64)
    if size > step:
        raise ValueError("too long a run")
    for a in range(0, n, step):
        part = h[a : a + step + size - 1]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * power[: len(part)], out=sums[1:])
        k = len(part) - size + 1
        out[a : a + k] = (sums[size:] - sums[:k]) * inverse[:k]
    return out


def cover(offs: np.ndarray, first: np.ndarray, size: int | np.ndarray, total: int) -> np.ndarray:
    """Mask of the words inside any window that starts at ``first``."""
    change = np.zeros(total + 1, np.int32)
    np.add.at(change, first, 1)
    np.add.at(change, np.minimum(first + size, total), -1)
    return np.cumsum(change[:-1]) > 0


def per_doc(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sum of ``values`` over each document's slice; empty slices give 0."""
    sums = np.concatenate([[0], np.cumsum(values)])
    return sums[offs[1:]] - sums[offs[:-1]]


def map_texts(docs, make, out: str, columns: tuple[str, ...] = ("text",), row: bool = False, limit: int = CHUNK_BYTES):
    """``doc_id`` and what ``make()`` finds in each chunk, one row for each document, in one Arrow pass.

    ``make`` is called once a task and returns a function from a chunk (with ``columns``) to the arrays of
    the columns in ``out``. With ``row`` a struct ``row`` carries all columns of ``docs`` along, so that
    names cannot clash.
    """
    from pyspark.sql import functions as F

    own = ["doc_id", *columns]
    frame = docs.select(*own, *([F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row")] if row else []))
    names = ["doc_id", *(c.strip().split(" ")[0].split(":")[0] for c in _split_schema(out)), *(["row"] if row else [])]
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {out}" + (f", row {frame.schema['row'].dataType.simpleString()}" if row else "")

    def run(batches):
        f = make()
        for batch in batches:
            for part in chunks(batch, columns[0], limit):
                arrays = [part.column("doc_id"), *f(part), *([part.column("row")] if row else [])]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return frame.mapInArrow(run, schema)


def _split_schema(out: str) -> list[str]:
    """Top-level parts of a DDL column list."""
    parts, depth, at = [], 0, 0
    for i, c in enumerate(out):
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            parts.append(out[at:i])
            at = i + 1
    return [*parts, out[at:]]
