"""Substring dedup: every word inside a window of words that also starts earlier is removed.

Super-k-mer partitioning. A window of ``window`` words has a minimiser, the least hash among its runs of
``minimiser`` words. Consecutive windows of a text with one minimiser travel together, as one packed string
(their words, one space between), to the bucket that the minimiser names; there the windows are hashed,
sorted and counted, and every window but the first (by document, then place) becomes a removal range.

* Pre-aggregation: within a chunk (4 MB of a task's texts) equal packed strings are sent once, for their
  first occurrence; all others there are known to be repeats at once and only their ranges travel.
* Hot minimisers: a sample of documents, whose size follows the input, names minimisers that would fill a good
  part of a bucket by themselves; their windows travel one by one, dealt by the window's own hash. This decides
  only where a window is counted, not whether.
* Packed strings go in zstd blobs, one for each chunk and bucket; the number of buckets follows the input.
  A bucket is counted from its blobs in as many passes over hashes of windows as its size needs, so a bucket
  that the sample did not foresee takes longer, not more memory.

Windows are compared by 128 bits of hash. Defined cases: identifiers are of any integer type, others are an error; null or empty texts have no words; texts with fewer
words than a window keep all; rows of one identifier with different texts count as documents of their own,
ordered by the text's hash; rows equal in identifier and text get the same result as one such row; a null
identifier sorts first; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as X
from . import pieces as P
from ._store import long_ids

NO_ID = -(1 << 63)


@dataclass(frozen=True)
class Params:
    window: int = 20
    minimiser: int = 3
    chunk_bytes: int = 4 << 20  # of a task's texts, deduplicated and packed together
    bucket_bytes: int = 8 << 20  # of text
    partitions: int = 20_000  # of the shuffle at most; each then holds several buckets, counted one after the other
    sample_docs: int = 20_000  # at least, and one in ``sample_every`` of all
    sample_every: int = 64
    windows: int = 2 << 20  # hashes that are sorted at once
    hot_limit: int = 1 << 20  # minimisers that are dealt by window (8 bytes each in every task)


def slide_min(x: np.ndarray, size: int) -> np.ndarray:
    """Minimum of each ``size`` values after one another."""
    out, have = x, 1
    while have * 2 <= size:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(out) - (size - have)], out[size - have :]) if size > have else out


class Runs:
    """The packed strings of a chunk: where they start, how many windows they hold, and their minimisers."""

    def __init__(self, words: X.Words, h: np.ndarray, p: Params, hot: np.ndarray):
        first, doc = X.windows(words.counts, p.window)
        if not len(first):
            self.first, self.count, self.doc, self.key = first, first, doc, np.zeros(0, np.uint64)
            return
        grams = X.combine(h, np.arange(len(h) - p.minimiser + 1), p.minimiser)
        least = slide_min(grams, p.window - p.minimiser + 1)[first]
        new = np.ones(len(first), bool)
        new[1:] = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])
        key = least
        if len(hot):
            at = np.minimum(np.searchsorted(hot, least), len(hot) - 1)
            alone = hot[at] == least
            if alone.any():
                new |= alone
                key = least.copy()
                key[alone] = X.combine(h, first[alone], p.window)
        begin = np.flatnonzero(new)
        self.first, self.doc, self.key = first[begin], doc[begin], key[begin]
        self.count = np.diff(np.append(begin, len(first)))


def packed(words: X.Words, runs: Runs, window: int) -> pa.LargeBinaryArray:
    """The runs' words with one space between."""
    n = words.ends - words.starts
    at = np.cumsum(n + 1) - (n + 1)
    flat = np.full(int((n + 1).sum()), 32, np.uint8)
    within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    flat[np.repeat(at, n) + within] = words.data[np.repeat(words.starts, n) + within]
    last = runs.first + runs.count + window - 2
    start, size = at[runs.first], at[last] + n[last] - at[runs.first]
    offs = np.concatenate([[0], np.cumsum(size)])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offs.astype(np.int64)), pa.py_buffer(P.gather(flat, start, size))])


def _pack(*arrays: np.ndarray) -> bytes:
    body = b"".join(np.uint32(len(a) * a.itemsize).tobytes() + a.tobytes() for a in arrays)
    return zstandard.compress(body, 7)


def _unpack(blob: bytes, kinds) -> list[np.ndarray]:
    body, at, out = zstandard.decompress(blob), 0, []
    for kind in kinds:
        n = int(np.frombuffer(body, np.uint32, 1, at)[0])
        out.append(np.frombuffer(body, kind, n // np.dtype(kind).itemsize, at + 4))
        at += 4 + n
    return out


_STRINGS = (np.uint8, np.uint32, np.uint32, np.uint32, np.int64, np.int64)  # bytes, sizes, document, start; documents' ids and hashes
_RANGES = (np.uint32, np.uint32, np.uint32, np.int64, np.int64)  # document, from, to; documents' ids and hashes


def _documents(doc: np.ndarray, ids: np.ndarray, text_hash: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    used, local = np.unique(doc, return_inverse=True)
    return local.astype(np.uint32), ids[used], text_hash[used]


def _deal(p: Params, buckets: int, hot: np.ndarray):
    def deal(batches):
        for batch in batches:
            for part in X.chunks(batch, limit=p.chunk_bytes):
                ids = part.column("doc_id").cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False)
                text_hash = part.column("text_hash").to_numpy(zero_copy_only=False)
                words = X.find_words(X.text_bytes(part.column("text")))
                runs = Runs(words, X.hash_words(words), p, hot)
                if not len(runs.first):
                    continue
                start = runs.first - words.offs[runs.doc]
                strings = packed(words, runs, p.window).dictionary_encode()
                which = np.asarray(strings.indices)
                # Order of occurrences: identifier, text hash, place. The first of each string is sent.
                order = np.lexsort((start, text_hash[runs.doc], ids[runs.doc], which))
                lead = np.ones(len(order), bool)
                lead[1:] = which[order][1:] != which[order][:-1]
                head = order[lead]
                of = head[np.cumsum(lead) - 1]
                again = (ids[runs.doc[order]] != ids[runs.doc[of]]) | (text_hash[runs.doc[order]] != text_hash[runs.doc[of]]) | (start[order] != start[of])
                rest = order[again]
                rows = []
                if len(rest):
                    doc, own, hashes = _documents(runs.doc[rest], ids, text_hash)
                    ranges = _pack(doc, start[rest].astype(np.uint32), (start[rest] + runs.count[rest] + p.window - 1).astype(np.uint32), own, hashes)
                    rows.append((int(text_hash[0]) % buckets, None, ranges, 0))
                bucket = (X.mix(runs.key[head]) % np.uint64(buckets)).astype(np.int64)
                by = np.argsort(bucket, kind="stable")
                head, bucket = head[by], bucket[by]
                edges = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket))
                content = strings.dictionary
                raw = np.frombuffer(content.buffers()[2], np.uint8)
                offs = np.frombuffer(content.buffers()[1], np.int64)[content.offset : content.offset + len(content) + 1]
                for a, b in zip(edges[:-1], edges[1:], strict=True):
                    mine = head[a:b]
                    at = which[mine]
                    size = offs[at + 1] - offs[at]
                    doc, own, hashes = _documents(runs.doc[mine], ids, text_hash)
                    rows.append((int(bucket[a]), _pack(P.gather(raw, offs[at], size), size.astype(np.uint32), doc, start[mine].astype(np.uint32), own, hashes), None, int(runs.count[mine].sum())))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary()), pa.array([r[3] for r in rows], pa.int64())],
                    names=["bucket", "strings", "ranges", "n"],
                )

    return deal


def _rank(ids: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rank of each (identifier, hash), and both by rank."""
    order = np.lexsort((hashes, ids))
    new = np.ones(len(order), bool)
    new[1:] = (ids[order][1:] != ids[order][:-1]) | (hashes[order][1:] != hashes[order][:-1])
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new) - 1
    return rank, ids[order][new], hashes[order][new]


def _merge(doc: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of ranges [a, b) in each document."""
    if not len(doc):
        return doc, a, b
    order = np.lexsort((a, doc))
    doc, a, b = doc[order], a[order], b[order]
    shift = doc * (1 << 33)
    reach = np.maximum.accumulate(b + shift)
    new = np.ones(len(doc), bool)
    new[1:] = (a + shift)[1:] > reach[:-1]
    begin = np.flatnonzero(new)
    last = np.append(begin[1:], len(doc)) - 1
    return doc[begin], a[begin], reach[last] - shift[begin]


def _windows(blobs: list[bytes], p: Params, passes: int, k: int):
    """Two hashes, document (place among all blobs') and start of the windows whose hash falls to pass ``k``."""
    out, base, todo, size_so_far = [], 0, [], 0

    def hashed():
        size = np.concatenate([x[1] for x in todo]).astype(np.int64)
        words = X.find_words(X.Bytes(np.concatenate([x[0] for x in todo]), np.concatenate([[0], np.cumsum(size)])))
        h = X.hash_words(words)
        first, string = X.windows(words.counts, p.window)
        key = X.combine(h, first, p.window)
        if passes > 1:
            mine = np.flatnonzero((key >> np.uint64(20)) % np.uint64(passes) == k)
            first, string, key = first[mine], string[mine], key[mine]
        second = X.combine(X.mix(h + np.uint64(0xA5A5A5A5)), first, p.window)
        owner, start = np.concatenate([x[2] for x in todo]), np.concatenate([x[3] for x in todo]).astype(np.int64)
        out.append((key, second, owner[string].astype(np.int32), (start[string] + first - words.offs[string]).astype(np.int32)))

    for blob in blobs:
        raw, size, d, s, own, _ = _unpack(blob, _STRINGS)
        todo.append((raw, size, d.astype(np.int64) + base, s))
        base += len(own)
        size_so_far += len(raw)
        if size_so_far > 2 << 20:
            hashed()
            todo, size_so_far = [], 0
    if todo:
        hashed()
    return [np.concatenate(x) for x in zip(*out, strict=True)]


def repeats(key, second, owner, at) -> tuple[np.ndarray, np.ndarray]:
    """Document rank and start of every window that is not its first occurrence."""
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])] if len(order) else order
    key, second, owner, at = key[twice], second[twice], owner[twice], at[twice]
    order = np.lexsort((at, owner, second, key))
    key, second, owner, at = key[order], second[order], owner[order], at[order]
    lead = np.ones(len(key), bool)
    lead[1:] = (key[1:] != key[:-1]) | (second[1:] != second[:-1])
    head = np.maximum.accumulate(np.where(lead, np.arange(len(key)), 0))
    later = (owner != owner[head]) | (at != at[head])
    return owner[later].astype(np.int64), at[later].astype(np.int64)


def _counted(blobs: list[bytes], ranges: list[bytes], n: int, p: Params) -> pa.RecordBatch:
    """Removal ranges of one bucket."""
    ids, hashes, doc, a, b, base = [], [], [], [], [], 0
    for blob in blobs:
        *_, own, own_hash = _unpack(blob, _STRINGS)
        ids.append(own)
        hashes.append(own_hash)
        base += len(own)
    for blob in ranges:
        d, f, t, own, own_hash = _unpack(blob, _RANGES)
        doc.append(d.astype(np.int64) + base)
        a.append(f.astype(np.int64))
        b.append(t.astype(np.int64))
        ids.append(own)
        hashes.append(own_hash)
        base += len(own)
    rank, ids, hashes = _rank(np.concatenate(ids), np.concatenate(hashes))
    doc = [rank[d] for d in doc]
    passes = -(-n // p.windows)
    for k in range(passes):
        key, second, owner, at = _windows(blobs, p, passes, k)
        owner, at = repeats(key, second, rank[owner], at)
        merged = _merge(owner, at, at + p.window)
        for to, found in zip((doc, a, b), merged, strict=True):
            to.append(found)
    none = np.zeros(0, np.int64)
    d, f, t = _merge(np.concatenate([none, *doc]), np.concatenate([none, *a]), np.concatenate([none, *b]))
    begin = np.append(np.flatnonzero(np.diff(d, prepend=-1)), len(d))
    packed_ranges = [np.stack([f[i:j], t[i:j]], 1).astype(np.uint32).tobytes() for i, j in zip(begin[:-1], begin[1:], strict=True)]
    of = d[begin[:-1]] if len(d) else d
    return pa.RecordBatch.from_arrays([pa.array(ids[of], pa.int64()), pa.array(hashes[of], pa.int64()), pa.array(packed_ranges, pa.binary())], names=["id", "text_hash", "ranges"])


def _count(p: Params):
    def count(batches):
        """Rows come bucket by bucket; only one bucket's blobs are held."""
        bucket, blobs, ranges, n = None, [], [], 0
        for batch in batches:
            for own, blob, range_, many in zip(*(batch.column(i) for i in range(4)), strict=True):
                if own.as_py() != bucket:
                    if bucket is not None:
                        yield _counted(blobs, ranges, n, p)
                    bucket, blobs, ranges, n = own.as_py(), [], [], 0
                if blob.is_valid:
                    blobs.append(blob.as_py())
                else:
                    ranges.append(range_.as_py())
                n += many.as_py()
        if bucket is not None:
            yield _counted(blobs, ranges, n, p)

    return count


def hot_minimisers(docs: DataFrame, p: Params) -> np.ndarray:
    """Minimisers that would fill a quarter of what is sorted at once by themselves, by a sample; sorted."""
    every = max(1, min(docs.count() // p.sample_docs, p.sample_every))
    sample = docs.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(every)) == 0).select("text") if every > 1 else docs.select("text")

    def count(batches):
        for batch in batches:
            for part in X.chunks(batch):
                words = X.find_words(X.text_bytes(part.column("text")))
                runs = Runs(words, X.hash_words(words), p, np.zeros(0, np.uint64))
                keys, back = np.unique(runs.key, return_inverse=True)
                n = np.bincount(back, runs.count, len(keys)) if len(keys) else np.zeros(0)
                big = n >= 2 * p.window
                yield pa.RecordBatch.from_arrays([pa.array(keys[big].view(np.int64)), pa.array(n[big].astype(np.int64))], names=["key", "n"])

    counts = sample.mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    rows = counts.filter(F.col("n") * every >= p.windows // 4).orderBy(F.desc("n"), "key").limit(p.hot_limit).collect()
    return np.sort(np.array([r.key for r in rows], np.int64).view(np.uint64))


def removal_ranges(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """id, text_hash, list of packed (from, to) word ranges to remove; only documents that have some."""
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // p.bucket_bytes))
    parts = min(buckets, p.partitions)
    source = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    dealt = source.mapInArrow(_deal(p, buckets, hot_minimisers(docs, p)), "bucket int, strings binary, ranges binary, n long")
    placed = dealt.repartitionById(parts, (F.col("bucket") % parts).cast("int")).sortWithinPartitions("bucket")
    found = placed.mapInArrow(_count(p), "id long, text_hash long, ranges binary")
    return found.groupBy("id", "text_hash").agg(F.collect_list("ranges").alias("ranges"))


def substring_dedup(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words of every document, one space between."""
    docs = long_ids(docs)
    found = removal_ranges(docs, p)
    source = docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), F.xxhash64("text").alias("text_hash"))
    both = source.join(found, ["id", "text_hash"], "left").select("doc_id", "text", "ranges")

    def make():
        def run(part):
            text = X.text_bytes(part.column("text"))
            words = X.find_words(text)
            total = len(words.starts)
            lists = part.column("ranges")
            edge = np.zeros(total + 1, np.int64)
            for i, own in enumerate(lists.to_pylist()):
                for blob in own or ():
                    pairs = np.frombuffer(blob, np.uint32).reshape(-1, 2).astype(np.int64) + words.offs[i]
                    np.add.at(edge, pairs[:, 0], 1)
                    np.add.at(edge, pairs[:, 1], -1)
            gone = np.cumsum(edge[:-1]) > 0
            keep = np.flatnonzero(~gone)
            n = (words.ends - words.starts)[keep] + 1
            flat = np.full(int(n.sum()), 32, np.uint8)
            within = np.arange(int((n - 1).sum())) - np.repeat(np.cumsum(n - 1) - (n - 1), n - 1)
            flat[np.repeat(np.cumsum(n) - n, n - 1) + within] = words.data[np.repeat(words.starts[keep], n - 1) + within]
            at = np.concatenate([[0], np.cumsum(n)])[np.searchsorted(keep, words.offs)]
            kept = [flat[a : max(a, b - 1)].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
            removed = X.per_doc(gone.astype(np.int64), words.offs)
            return [pa.array(words.counts.astype(np.int64)), pa.array(removed.astype(np.int64)), pa.array(kept, pa.binary()).cast(pa.string())]

        return run

    return X.map_texts(both, make, "n_words long, n_removed long, kept_text string", ("text", "ranges"))
