"""Token ids in sorted-string-table shards, keyed by document identifier.

File layout (little-endian; every section ends with the byte 0x0A, which the line writer adds):

* data blocks: entries ``varint shared | varint unshared | varint value bytes | key suffix | value``; the key
  shares its first ``shared`` bytes with the entry before; every 16th entry is a restart (shared = 0). Then
  the restarts' offsets and their number (uint32), and the block's crc32.
* index: per block ``varint key bytes | first key | uint64 offset | uint32 length``, then the entries' offsets
  and their number (uint32), so that a reader can bisect it in place.
* Bloom filter over the keys: bits, about 10 a key, 7 probes by double hashing.
* footer, 64 bytes with its 0x0A: offsets and lengths of index and filter, documents, ids, shard number, id
  width (2 or 4 bytes), probes, magic.

A value is a document's ids in 2 or 4 bytes each, whichever the vocabulary needs. Keys sort as their
documents do: integers as 8 big-endian bytes with the sign bit flipped, strings as UTF-8, null first as the
empty key. Texts are dealt to shards by ranges of (identifier, hash of the text), about ``shard_bytes`` of text
each, and encoded by the task that writes their shard, chunk by chunk: a writer holds a chunk, one block and its
keys. An identifier that holds more than a shard is spread over several. Files are written and read with
Spark's own text and binaryFile sources, so any store it knows will do, and a task's commit makes a whole shard
appear or nothing. Readers parse every file once; starts are running sums in DataFrame functions.

Defined cases: null and empty texts have only the end id; repeated identifiers are kept as entries of their
own, ordered by a hash of their texts; an empty string as an identifier shares the empty key with null and
sorts with it; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from . import _text as X
from . import pieces as P
from ._store import new_path, stored

MAGIC = b"RLYSST1"
FOOTER = struct.Struct("<QIQIQQIBB")
FOOTER_BYTES = 64
RESTART = 16
PROBES = 7


@dataclass(frozen=True)
class Layout:
    end_id: int = 2
    block_bytes: int = 256 << 10
    shard_bytes: int = 64 << 20
    least_shard_bytes: int = 4 << 20


def key_bytes(doc_id) -> bytes:
    if doc_id is None:
        return b""
    return (doc_id + (1 << 63)).to_bytes(8, "big") if isinstance(doc_id, int) else str(doc_id).encode()


def key_value(key: bytes, integer: bool):
    if not key:
        return None
    return int.from_bytes(key, "big") - (1 << 63) if integer else key.decode()


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 0x7F) << shift
        if b < 0x80:
            return n, at
        shift += 7


def _probes(key: bytes, bits: int) -> list[int]:
    h = zlib.crc32(key) << 32 | zlib.crc32(key, 0x5BD1E995)
    h = (h * 0x9E3779B97F4A7C15) & (1 << 64) - 1
    a, b = h >> 32, h & 0xFFFFFFFF | 1
    return [(a + i * b) % bits for i in range(PROBES)]


class Writer:
    """Turns sorted (key, value) pairs into the sections of one file, section by section."""

    def __init__(self, shard: int, width: int, block_bytes: int):
        self.shard, self.width, self.block_bytes = shard, width, block_bytes
        self.offset, self.index, self.keys, self.ids = 0, [], [], 0
        self._open()

    def _open(self):
        self.block, self.restarts, self.count, self.last, self.first = bytearray(), [], 0, b"", b""

    def _emit(self, section: bytes) -> bytes:
        self.offset += len(section) + 1
        return section

    def add(self, key: bytes, value: bytes):
        """Yields a section when a block is full."""
        shared = 0
        if self.count % RESTART:
            most = min(len(key), len(self.last))
            while shared < most and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.restarts.append(len(self.block))
        if not self.count:
            self.first = key
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.count += 1
        self.last = key
        self.keys.append(key)
        self.ids += len(value) // self.width
        if len(self.block) >= self.block_bytes:
            yield self._close()

    def _close(self) -> bytes:
        body = bytes(self.block) + struct.pack(f"<{len(self.restarts) + 1}I", *self.restarts, len(self.restarts))
        section = body + struct.pack("<I", zlib.crc32(body))
        self.index.append((self.first, self.offset, len(section)))
        self._open()
        return self._emit(section)

    def finish(self):
        if self.count:
            yield self._close()
        index_at = self.offset
        entries = [_varint(len(k)) + k + struct.pack("<QI", o, n) for k, o, n in self.index]
        starts = np.concatenate([[0], np.cumsum([len(e) for e in entries])])[: len(entries)].astype("<u4")
        index = b"".join(entries) + starts.tobytes() + struct.pack("<I", len(entries))
        yield self._emit(index)
        bits = max(64, 10 * len(self.keys)) + 7 & ~7
        bloom = np.zeros(bits // 8, np.uint8)
        for k in self.keys:
            for p in _probes(k, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        bloom_at = self.offset
        yield self._emit(bloom.tobytes())
        footer = FOOTER.pack(index_at, len(index), bloom_at, len(bloom), len(self.keys), self.ids, self.shard, self.width, PROBES)
        yield self._emit(footer + b"\0" * (FOOTER_BYTES - 1 - len(footer) - len(MAGIC)) + MAGIC)


class Reader:
    """A shard's bytes: footer, sparse index, Bloom filter; scanning and looking up."""

    def __init__(self, data: bytes):
        self.data = data
        tail = data[-FOOTER_BYTES:]
        if len(tail) < FOOTER_BYTES or tail[-1 - len(MAGIC) :] != MAGIC + b"\n":
            raise ValueError("not a complete shard")
        self.index_at, self.index_len, self.bloom_at, self.bloom_len, self.n_docs, self.n_ids, self.shard, self.width, _ = FOOTER.unpack_from(tail)

        end = self.index_at + self.index_len
        self.n_blocks = struct.unpack_from("<I", data, end - 4)[0]
        self.entry_at = np.frombuffer(data, "<u4", self.n_blocks, end - 4 - 4 * self.n_blocks)

    def block(self, i: int) -> tuple[bytes, int, int]:
        """First key, offset and length of the i-th block."""
        n, at = _read_varint(self.data, self.index_at + int(self.entry_at[i]))
        return self.data[at : at + n], *struct.unpack_from("<QI", self.data, at + n)

    def entries(self, offset: int, length: int, key: bytes = b""):
        """Entries of a block; with ``key``, from the last restart before it on."""
        data = memoryview(self.data)[offset : offset + length]
        if zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError(f"block at {offset} is damaged")
        n = struct.unpack("<I", data[-8:-4])[0]
        end = length - 8 - 4 * n
        restarts = np.frombuffer(data, "<u4", n, end)
        low, high = 0, n - 1
        while key and low < high:
            mid = (low + high + 1) // 2
            at = _read_varint(data, int(restarts[mid]))[1]
            unshared, at = _read_varint(data, at)
            at = _read_varint(data, at)[1]
            if bytes(data[at : at + unshared]) < key:
                low = mid
            else:
                high = mid - 1
        at, last = int(restarts[low]) if n else 0, b""
        while at < end:
            shared, at = _read_varint(data, at)
            unshared, at = _read_varint(data, at)
            size, at = _read_varint(data, at)
            last = last[:shared] + bytes(data[at : at + unshared])
            at += unshared
            yield last, data[at : at + size]
            at += size

    def scan(self):
        for i in range(self.n_blocks):
            yield from self.entries(*self.block(i)[1:])

    def ids(self, value) -> np.ndarray:
        return np.frombuffer(value, "<u2" if self.width == 2 else "<u4").astype("<u4")

    def may_hold(self, key: bytes) -> bool:
        bits = self.bloom_len * 8
        return all(self.data[self.bloom_at + (p >> 3)] >> (p & 7) & 1 for p in _probes(key, bits))

    def lookup(self, doc_id) -> np.ndarray | None:
        """Bloom filter, binary search over the sparse index and over a block's restarts, then a short scan."""
        key = key_bytes(doc_id)
        if not self.n_blocks or not self.may_hold(key):
            return None
        low, high = 0, self.n_blocks - 1
        while low < high:  # the last block that begins before the key: repeated keys may begin in it
            mid = (low + high + 1) // 2
            low, high = (mid, high) if self.block(mid)[0] < key else (low, mid - 1)
        for i in range(low, self.n_blocks):
            for k, v in self.entries(*self.block(i)[1:], key):
                if k == key:
                    return self.ids(v)
                if k > key:
                    return None
        return None


@lru_cache(maxsize=2)
def _encoder(path: str) -> tuple[P.PieceCache, P.Cutter]:
    """The library's tokenizer behind a cache of pieces, one for each worker process."""
    tokenizer = P.plain_tokenizer(path)
    return P.PieceCache(P.library_encoder(tokenizer, P.bytes_of_tokens(tokenizer))), P.Cutter(tokenizer)


def with_end(ids: np.ndarray, offs: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Every document's ids followed by ``end_id``."""
    many = len(offs) - 1
    out, last = np.empty(len(ids) + many, ids.dtype), offs[1:] + np.arange(many)
    inside = np.ones(len(out), bool)
    inside[last] = False
    out[inside], out[last] = ids, end_id
    return out, offs + np.arange(many + 1)


def write_shards(docs: DataFrame, path: str, tokenizer_path: str, layout: Layout = Layout()) -> None:
    """Encodes all texts and writes one file for each range of identifiers under ``path``."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = max(1, -(-total // layout.shard_bytes), min(parts, total // layout.least_shard_bytes))
    wide = len(P.bytes_of_tokens(P.plain_tokenizer(tokenizer_path)))
    width = 2 if max(wide, layout.end_id + 1) <= 1 << 16 else 4
    keys = [F.col("doc_id").asc_nulls_first(), F.col("tie").asc()]
    own = F.col("doc_id").cast("long") if isinstance(docs.schema["doc_id"].dataType, IntegralType) else F.col("doc_id").cast("string")
    placed = docs.select(own.alias("doc_id"), "text", F.xxhash64("text").alias("tie")).repartitionByRange(n, *keys).sortWithinPartitions(*keys)

    def build(batches):
        cache, cutter = _encoder(tokenizer_path)
        writer = Writer(TaskContext.get().partitionId(), width, layout.block_bytes)
        for batch in batches:
            for part in X.chunks(batch, limit=P.CHUNK_BYTES):
                ids, at = with_end(*P.encode_chunk(X.text_bytes(part.column("text")), cache, cutter), layout.end_id)
                values, at = memoryview(ids.astype("<u2" if width == 2 else "<u4").tobytes()), (at * width).tolist()
                sections = []
                for key, a, b in zip(part.column("doc_id").to_pylist(), at[:-1], at[1:], strict=True):
                    sections += writer.add(key_bytes(key), bytes(values[a:b]))
                if sections:
                    yield pa.RecordBatch.from_arrays([pa.array(sections, pa.binary())], names=["section"])
        if writer.keys:
            for section in writer.finish():
                yield pa.RecordBatch.from_arrays([pa.array([section], pa.binary())], names=["section"])

    sections = placed.select("doc_id", "text").mapInArrow(build, "section binary")
    sections.select(F.col("section").cast("string")).write.option("compression", "none").option("maxRecordsPerFile", 0).text(path)


def read_shards(spark: SparkSession, path: str, integer_keys: bool = True, with_ids: bool = False) -> DataFrame:
    """Every document in the files under ``path``: doc_id, start (ids of all before it), n_tokens, ids_crc32."""

    def parse(batches):
        for batch in batches:
            for content in batch.column("content"):
                shard = Reader(content.as_py())
                keys, at, sizes, sums, all_ids = [], [], [], [], []
                place = 0
                for key, value in shard.scan():
                    ids = shard.ids(value)
                    keys.append(key_value(key, integer_keys))
                    at.append(place)
                    sizes.append(len(ids))
                    sums.append(zlib.crc32(ids))
                    place += len(ids)
                    if with_ids:
                        all_ids.append(ids)
                if (len(keys), place) != (shard.n_docs, shard.n_ids):
                    raise ValueError(f"shard {shard.shard} does not hold what its footer says")
                arrays = [pa.array([shard.shard] * len(keys), pa.int32()), pa.array(keys, pa.int64() if integer_keys else pa.string()), pa.array(at, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays + ([pa.array(all_ids, pa.list_(pa.int64()))] if with_ids else []), names=["shard", "doc_id", "at", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)

    schema = f"shard int, doc_id {'long' if integer_keys else 'string'}, at long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).filter("length > 0")
    docs = stored(files.select("content").mapInArrow(parse, schema), "parsed-shards")
    # Running sums in two steps, so that only one row for every 1024 shards meets in one task.
    totals = docs.groupBy("shard").agg(F.sum("n_tokens").alias("n")).withColumn("block", F.floor(F.col("shard") / 1024))
    inside = totals.withColumn("before", F.sum("n").over(W.partitionBy("block").orderBy("shard")) - F.col("n"))
    blocks = totals.groupBy("block").agg(F.sum("n").alias("n")).select("block", (F.sum("n").over(W.orderBy("block")) - F.col("n")).alias("base"))
    starts = inside.join(blocks, "block").select("shard", (F.col("base") + F.col("before")).alias("base"))
    return docs.join(starts, "shard").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def token_shards(docs: DataFrame, tokenizer_path: str, layout: Layout = Layout()) -> DataFrame:
    """Writes the shards to a new folder of the shared store and reads them back."""
    path = new_path(docs.sparkSession, "token-shards")
    write_shards(docs, path, tokenizer_path, layout)
    return read_shards(docs.sparkSession, path, isinstance(docs.schema["doc_id"].dataType, IntegralType))
