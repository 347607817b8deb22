"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

1. One Arrow pass makes each document's set of word shingles (64-bit hashes), a 128-bit digest of the set
   and its sketch: in round i every element throws one value into one of ``size`` bins, and rounds go on
   until each bin has been hit (from round ``size`` on, round ``size + j`` aims all elements at bin j, so
   every coordinate is filled). Documents with equal sets form a class; one represents it.
2. ``bands`` keys of ``rows`` coordinates each: representatives that share a key are candidates. Each is
   tied to the smallest one under its key (not to all), and the ties' components are candidate groups: all
   pairs that share a key lie inside one. At a similarity of exactly 0.85, 25 bands of 5 miss a pair with
   probability 5e-7.
3. Groups are cut into parts of at most ``part`` sets and ``part_bytes``. Inside a part all pairs are decided
   exactly from an inverted index over the full sets, and only a spanning forest of the links leaves it.
4. A group of several parts is cut a second time, otherwise: as a dense group's parts mix, its links meet. Then
   only pairs that share a band key and are not connected yet are open. Sets that cannot link to any other (too
   many shingles that nobody else in the group has) rest, and keys whose sets are all connected are done. The
   sets under a remaining key meet; where they are more than a part, the sets outside the largest connected class
   of all such keys that hang together meet the others in blocks. No pair is emitted that isn't a link, and none
   is lost.
5. Links' components give each document the smallest identifier that it can reach.

Disk and shuffle: sketches' keys twice, texts once (only those of candidate groups go on as sets).

Defined cases: identifiers are of any integer type, others are an error; null or empty texts, or texts without words, have an empty set and link with nothing; fewer
words than a shingle make one shingle of all; repeated rows of an identifier are documents of their own that
share its identifier; a null identifier is kept, in a component of its own; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as X
from ._graph import components
from ._store import long_ids, stored


@dataclass(frozen=True)
class Similar:
    shingle: int = 5
    percent: int = 80  # link: 100 * intersection >= percent * union
    bands: int = 25
    rows: int = 5
    part: int = 128  # sets that meet in one place
    part_bytes: int = 2 << 20  # and what they hold, unless one holds more
    group_bytes: int = 24 << 20  # of sets in one task's group

    @property
    def size(self) -> int:
        return self.bands * self.rows


def shingle_sets(part: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts after one another, and their offsets."""
    words = X.find_words(X.text_bytes(part.column("text")), lower=True)
    h = X.hash_words(words)
    first, doc = X.windows(words.counts, size)
    key = X.combine(h, first, size)
    short = np.flatnonzero((words.counts > 0) & (words.counts < size))
    if len(short):
        whole = np.array([_whole(h[words.offs[d] : words.offs[d + 1]]) for d in short], np.uint64)
        key, doc = np.concatenate([key, whole]), np.concatenate([doc, short])
    order = np.lexsort((key, doc))
    key, doc = key[order], doc[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    key, doc = key[new], doc[new]
    return key, np.searchsorted(doc, np.arange(part.num_rows + 1))


def _whole(h: np.ndarray) -> np.uint64:
    """A short text's only shingle; its number of words counts."""
    return X.combine(np.append(h, np.uint64(len(h))), np.zeros(1, np.int64), len(h) + 1)[0]


def sketch(keys: np.ndarray, offs: np.ndarray, size: int) -> np.ndarray:
    """Fast similarity sketches, one row a set; rows of empty sets are all ones."""
    n, empty = len(offs) - 1, np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full((n, size), empty, np.uint64)
    flat = out.reshape(-1)
    counts = np.diff(offs)
    doc, element = np.repeat(np.arange(n), counts), keys
    low = np.uint64((1 << 48) - 1)
    for i in range(2 * size):
        if not len(doc):
            break
        with np.errstate(over="ignore"):
            h = X.mix(element + np.uint64((i + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        value = np.uint64(i) << np.uint64(48) | h & low
        place = (h >> np.uint64(48)).astype(np.int64) * size >> 16 if i < size else np.full(len(doc), i - size)
        np.minimum.at(flat, doc * size + place, value)
        open_ = (out == empty).any(1)
        keep = open_[doc]
        doc, element = doc[keep], element[keep]
    return out


def band_keys(sketches: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band, which knows its band's number."""
    h = np.broadcast_to(np.arange(bands, dtype=np.uint64), (len(sketches), bands)).copy()
    for j in range(rows):
        h = X.mix(h + sketches[:, j::rows][:, :bands])
    return h


def _digest(keys: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of a set: sums of two hashes of its elements."""
    out = []
    for salt in (0x51ED270B0E7C5A17, 0x2545F4914F6CDD1D):
        with np.errstate(over="ignore"):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(X.mix(keys + np.uint64(salt)), dtype=np.uint64)])
            out.append((sums[offs[1:]] - sums[offs[:-1]]).view(np.int64))
    return out[0], out[1]


def sketches(docs: DataFrame, s: Similar) -> DataFrame:
    """doc_id, n_shingles, set digest (h1, h2), band keys (null for empty sets)."""

    def run(part):
        keys, offs = shingle_sets(part, s.shingle)
        h1, h2 = _digest(keys, offs)
        n = np.diff(offs)
        bands = band_keys(sketch(keys, offs, s.size), s.bands, s.rows).view(np.int64)
        at = np.concatenate([[0], np.cumsum(np.where(n > 0, s.bands, 0))]).astype(np.int32)
        return [pa.array(n.astype(np.int64)), pa.array(h1), pa.array(h2), pa.ListArray.from_arrays(pa.array(at), pa.array(bands[n > 0].reshape(-1)))]

    return X.map_texts(docs, lambda: run, "n_shingles long, h1 long, h2 long, bands array<long>")


def links(keys: np.ndarray, offs: np.ndarray, percent: int, left: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (child, parent) of the links among the sets, decided on the full sets.

    With ``left`` (a mask) only pairs of a marked and an unmarked set are looked at.
    """
    n, size = len(offs) - 1, np.diff(offs)
    _, code = np.unique(keys, return_inverse=True)
    doc = np.repeat(np.arange(n), size)
    order = np.argsort(code, kind="stable")
    posting, start = doc[order], np.concatenate([[0], np.cumsum(np.bincount(code))])
    root = np.arange(n)

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    a, b = [], []
    for i in range(1, n) if left is None else np.flatnonzero(left):
        own = code[offs[i] : offs[i + 1]]
        many = start[own + 1] - start[own]
        place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(start[own], many)
        both = np.bincount(posting[place], minlength=n)
        near = 100 * both >= percent * (size[i] + size - both)
        near = np.flatnonzero(near[:i]) if left is None else np.flatnonzero(near & ~left)
        for j in near.tolist():
            x, y = find(i), find(j)
            if x != y:
                root[max(x, y)] = min(x, y)
                a.append(i)
                b.append(j)
    return np.array(a, np.int64), np.array(b, np.int64)


def _sets(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    blobs = table.column("shingles").combine_chunks()
    offs = np.frombuffer(blobs.buffers()[1], np.int32)[blobs.offset : blobs.offset + len(blobs) + 1].astype(np.int64)
    return np.frombuffer(blobs.buffers()[2], np.uint8)[offs[0] : offs[-1]].view(np.uint64) if offs[-1] > offs[0] else np.zeros(0, np.uint64), (offs - offs[0]) // 8


_EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _verify(percent: int):
    """Links inside each part of a task's group."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("place").combine_chunks()
        keys, offs = _sets(table)
        rep, place = table.column("rep").to_numpy(), table.column("place").to_numpy()
        edge = np.concatenate([[0], np.flatnonzero(place[1:] != place[:-1]) + 1, [len(rep)]])
        a, b = [], []
        for x, y in zip(edge[:-1], edge[1:], strict=True):
            if y - x > 1:
                i, j = links(keys[offs[x] : offs[y]], offs[x : y + 1] - offs[x], percent)
                a.append(rep[x + i])
                b.append(rep[x + j])
        return pa.table([np.concatenate([np.zeros(0, np.int64), *a]), np.concatenate([np.zeros(0, np.int64), *b])], schema=_EDGE)

    return run


def _cross(percent: int):
    """Links between the two sides of one block."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        keys, offs = _sets(table)
        rep = table.column("rep").to_numpy()
        i, j = links(keys, offs, percent, table.column("minor").to_numpy(zero_copy_only=False))
        return pa.table([rep[i], rep[j]], schema=_EDGE)

    return run


def representatives(found: DataFrame) -> DataFrame:
    """One document for each set digest: rep, its set's size and band keys. Equal sets combine before the shuffle."""
    first = found.filter("n_shingles > 0 and doc_id is not null").groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "bands", "n_shingles")).alias("m"))
    return first.select("h1", "h2", F.col("m.doc_id").alias("rep"), F.col("m.n_shingles").alias("n_shingles"), F.col("m.bands").alias("bands"))


def candidate_groups(reps: DataFrame) -> DataFrame:
    """rep, component: groups of representatives tied by shared band keys."""
    keyed = reps.select("rep", F.explode("bands").alias("key"))
    hubs = keyed.groupBy("key").agg(F.min("rep").alias("hub"), F.count("*").alias("n")).filter("n > 1").select("key", "hub")
    ties = keyed.join(hubs, "key").filter("rep <> hub").select(F.col("rep").alias("a"), F.col("hub").alias("b"))
    return components(ties).select(F.col("node").alias("rep"), "component")


def _in_parts(sets: DataFrame, tasks: int, salt: int, s: Similar) -> DataFrame:
    """Links inside the parts into which ``salt`` deals each group."""
    place = F.xxhash64("component", F.pmod(F.xxhash64("rep", F.lit(salt)), F.col("parts")))
    dealt = sets.select("rep", "shingles", place.alias("place")).withColumn("task", F.pmod(F.xxhash64("place"), F.lit(tasks)))
    return dealt.groupBy("task").applyInArrow(_verify(s.percent), "a long, b long")


def verified_links(docs: DataFrame, reps: DataFrame, groups: DataFrame, s: Similar) -> DataFrame:
    """a, b: links that connect whatever is connected."""
    spark = docs.sparkSession
    members = groups.join(reps.select("rep", "n_shingles"), "rep")
    sizes = members.groupBy("component").agg(F.greatest(F.ceil(F.count("*") / s.part), F.ceil(F.sum("n_shingles") * 8 / s.part_bytes)).cast("int").alias("parts"))
    placed = groups.join(sizes, "component")
    # A merge join at every size: the groups grow with the input, so a broadcast would only flatter small runs.
    texts = docs.select(F.col("doc_id").alias("rep"), "text").join(placed.hint("merge"), "rep").select(F.col("rep").alias("doc_id"), "text", "component", "parts")

    def run(part):
        keys, offs = shingle_sets(part, s.shingle)
        blobs = pa.BinaryArray.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer((offs * 8).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(keys))])
        return [blobs, part.column("component"), part.column("parts")]

    sets = stored(X.map_texts(texts, lambda: run, "shingles binary, component long, parts int", ("text", "component", "parts")).withColumnRenamed("doc_id", "rep"), "sets")
    total = sets.agg(F.sum(F.octet_length("shingles"))).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // s.group_bytes))
    edges = stored(_in_parts(sets, tasks, 0, s), "links")
    large = sets.filter("parts > 1")
    if not large.take(1):
        return edges
    edges = stored(edges.unionByName(_in_parts(large, tasks, 1, s)), "links")
    return edges.unionByName(_under_keys(large, reps, edges, s))


def _under_keys(large: DataFrame, reps: DataFrame, edges: DataFrame, s: Similar) -> DataFrame:
    """Links between sets that share a band key, lie in a group of several parts and are not connected yet."""

    def spread(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                keys, offs = _sets(pa.table([part.column("shingles")], names=["shingles"]))
                n = np.diff(offs)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(part.column("component").to_numpy(), n)), pa.array(np.repeat(part.column("rep").to_numpy(), n)), pa.array(keys.view(np.int64))], names=["component", "rep", "shingle"]
                )

    each = large.select("component", "rep", "shingles").mapInArrow(spread, "component long, rep long, shingle long")
    alone = each.groupBy("component", "shingle").agg(F.count("*").alias("n"), F.min("rep").alias("rep")).filter("n = 1").groupBy("rep").agg(F.count("*").alias("own"))
    linked = components(edges).select(F.col("node").alias("rep"), F.col("component").alias("class"))
    bytes_ = F.octet_length("shingles").cast("long")
    open_ = large.select("rep", bytes_.alias("bytes")).join(alone, "rep", "left").filter((F.col("bytes") / 8 - F.coalesce("own", F.lit(0))) * 100 >= F.col("bytes") / 8 * s.percent)
    classed = open_.join(linked, "rep", "left").select("rep", "bytes", F.coalesce("class", "rep").alias("class"))
    keyed = stored(reps.select("rep", F.explode("bands").alias("key")).join(classed, "rep"), "open-keys")
    # By key and class first: a class of any size is one row when a key is judged.
    of_class = keyed.groupBy("key", "class").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.min("rep").alias("hub"))
    judged = of_class.groupBy("key").agg(F.count("*").alias("classes"), F.sum("n").alias("n"), F.sum("bytes").alias("all"), F.min("hub").alias("hub")).filter("classes > 1")
    small = (F.col("n") <= s.part) & (F.col("all") <= s.part_bytes)
    open_keys = stored(keyed.join(judged.select("key", "hub", small.alias("small")), "key"), "judged-keys")
    sets = large.select("rep", "shingles")
    tasks = max(int(large.sparkSession.conf.get("spark.sql.shuffle.partitions")), open_keys.filter("small").count() // s.part)
    found = open_keys.filter("small").select("rep", F.col("key").alias("place")).join(sets, "rep").withColumn("task", F.pmod(F.xxhash64("place"), F.lit(tasks))).groupBy("task").applyInArrow(_verify(s.percent), "a long, b long")
    crowded = open_keys.filter("not small")
    if not crowded.take(1):
        return found
    clusters = components(crowded.select(F.col("rep").alias("a"), F.col("hub").alias("b"))).select(F.col("node").alias("rep"), F.col("component").alias("cluster"))
    members = stored(crowded.select("rep", "class", "bytes").distinct().join(clusters, "rep"), "crowded")
    by_class = members.groupBy("cluster", "class").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    whole = by_class.groupBy("cluster").agg(F.max(F.struct("n", "class", "bytes")).alias("m"), F.sum("n").alias("all"), F.sum("bytes").alias("all_bytes"))

    def parts(n, size):
        return F.greatest(F.ceil(n / (s.part / 2)), F.ceil(size / (s.part_bytes / 2))).cast("long")

    whole = whole.select("cluster", F.col("m.class").alias("main"), parts(F.col("all") - F.col("m.n"), F.col("all_bytes") - F.col("m.bytes")).alias("blocks"), parts(F.col("all"), F.col("all_bytes")).alias("pieces"))
    sided = members.join(whole, "cluster").select("cluster", "rep", "blocks", "pieces", (F.col("class") != F.col("main")).alias("minor"))
    # Every block of minors meets every part of all; a minor is on either side, so minors meet one another too.
    first = sided.filter("minor").select("cluster", "rep", F.lit(True).alias("minor"), F.pmod(F.xxhash64("rep"), F.col("blocks")).alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)).alias("piece"))
    second = sided.select("cluster", "rep", F.lit(False).alias("minor"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("rep", F.lit(1)), F.col("pieces")).alias("piece"))
    # One column for a cell: grouping by all three would be content with rows dealt by cluster alone.
    cells = first.unionByName(second).select("rep", "minor", F.xxhash64("cluster", "block", "piece").alias("cell"))
    met = cells.join(sets, "rep").groupBy("cell").applyInArrow(_cross(s.percent), "a long, b long")
    return found.unionByName(met.filter("a <> b"))


def near_dedup(docs: DataFrame, s: Similar = Similar()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every document."""
    docs = long_ids(docs)
    found = stored(sketches(docs, s), "sketches")
    reps = stored(representatives(found), "reps")
    groups = stored(candidate_groups(reps), "groups")
    labels = components(verified_links(docs, reps, groups, s)).withColumnRenamed("node", "rep")
    of_set = reps.select("h1", "h2", "rep").join(labels, "rep", "left").select("h1", "h2", F.coalesce("component", "rep").alias("component"))
    return found.drop("bands").join(of_set, ["h1", "h2"], "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.coalesce("component", "doc_id")).otherwise(F.col("doc_id")).alias("component_id")).withColumn(
        "kept", F.col("component_id").eqNullSafe(F.col("doc_id"))
    )
