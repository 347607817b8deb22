"""Benchmark decontamination with an FM-index per shard of training documents.

A shard is a chunk of a task's documents (4 MB of text, so memory does not grow with the input). Its words
become symbols; words that no item has separate runs, and runs shorter than the shortest phrase hold no
occurrence, so the index leaves both out. It is built once, and answers all phrases backwards, a block of the
benchmark at a time; positions come from sampled suffixes, and overlapping occurrences merge into removal spans.

The benchmark is a query set that reaches workers in broadcast blocks of at most ``block_bytes`` of text (one
item may be larger): the driver holds one block while it makes it, a worker one block while it searches, and
besides them the distinct words' hashes (8 bytes each). One Arrow pass, no shuffle; all documents meet all phrases.

Defined cases: null or empty texts have no words, no spans and are clean; an item without words matches
nothing; an item with fewer words than a window is one window; items with equal windows are all reported; one
with a null identifier counts in spans and n_hit like any other and is only left out of the list of items;
repeated rows are judged one by one; without items or documents nothing is contaminated; other columns of
either table are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as X
from .fm_index import FMIndex


@dataclass(frozen=True)
class Contamination:
    window: int = 13
    percent: int = 5  # of a document's words, at least, for it to be contaminated
    block_bytes: int = 1 << 20
    sample: int = 8  # every so many suffix positions are stored


class Phrases:
    """A block of the benchmark: its words' hashes, its windows by length (as rows of hashes), and whose they are."""

    def __init__(self, items: list[tuple[str | None, str]], window: int):
        text = X.text_bytes(pa.array([t for _, t in items], pa.string()))
        words = X.find_words(text, X.ALNUM, lower=True)
        h = X.hash_words(words)
        self.vocabulary = np.unique(h)
        owners: dict[tuple[int, ...], set[str]] = {}
        for k, (item, _) in enumerate(items):
            own = tuple(h[words.offs[k] : words.offs[k + 1]].tolist())
            for i in range(max(1, len(own) - window + 1) if own else 0):
                owners.setdefault(own[i : i + window], set()).update(() if item is None else (str(item),))
        self.by_length = {}
        for n in sorted({len(p) for p in owners}):
            same = [p for p in owners if len(p) == n]
            self.by_length[n] = (np.array(same, np.uint64), [sorted(owners[p]) for p in same])


class Words:
    """Which words any item has."""

    def __init__(self, vocabulary: np.ndarray):
        self.vocabulary, self.maybe = vocabulary, np.zeros(1 << 16, bool)
        self.maybe[(vocabulary >> np.uint64(48)).astype(np.int64)] = True

    def known(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h), bool)
        some = np.flatnonzero(self.maybe[(h >> np.uint64(48)).astype(np.int64)])
        if len(some):
            at = np.minimum(np.searchsorted(self.vocabulary, h[some]), len(self.vocabulary) - 1)
            out[some] = self.vocabulary[at] == h[some]
        return out


class Shard:
    """A chunk's words and the FM-index of their runs."""

    def __init__(self, h: np.ndarray, offs: np.ndarray, known: np.ndarray, shortest: int, sample: int):
        begins, ends = known.copy(), known.copy()
        begins[1:] &= ~known[:-1]
        ends[:-1] &= ~known[1:]
        cut = offs[:-1]
        cut = cut[(cut > 0) & (cut < len(h))]
        begins[cut] = known[cut]
        ends[cut - 1] = known[cut - 1]
        b, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        long = e - b >= shortest
        b, size = b[long], (e - b)[long] + 1  # a separator after each run
        self.index = None
        if len(b):
            self.place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(b, size)
            stop = np.zeros(len(self.place), bool)
            stop[np.cumsum(size) - 1] = True
            self.vocabulary, sym = np.unique(h[self.place[~stop]], return_inverse=True)
            text = np.zeros(len(self.place), np.int64)
            text[~stop] = sym + 1
            self.index = FMIndex(text, len(self.vocabulary), sample)

    def occurrences(self, phrases: Phrases):
        """Yields, by phrase length: the first words of all occurrences, the phrases' numbers, whose they are."""
        if self.index is None:
            return
        for n, (patterns, owners) in phrases.by_length.items():
            at = np.minimum(np.searchsorted(self.vocabulary, patterns), len(self.vocabulary) - 1)
            here = np.flatnonzero((self.vocabulary[at] == patterns).all(1))  # others have a word that the shard lacks
            lo, hi = self.index.search(at[here] + 1)
            many = hi - lo
            hit = np.flatnonzero(many > 0)
            if len(hit):
                many = many[hit]
                rows = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo[hit], many)
                yield n, self.place[self.index.locate(rows)], np.repeat(here[hit], many), owners


def blocks(benchmark: DataFrame, rules: Contamination):
    """The benchmark's items in parts of a bounded size, one after the other."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").filter("text is not null").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // rules.block_bytes) or 1
    if n == 1:
        yield [(r.item_id, r.text) for r in items.collect()]
        return
    # Dealt once; the driver then fetches a partition at a time, which holds whole blocks one after the other.
    dealt = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n))).repartition(int(n), "block").sortWithinPartitions("block")
    for _, rows in groupby(dealt.toLocalIterator(), key=lambda r: r.block):
        yield [(r.item_id, r.text) for r in rows]


SPANS = "spans array<struct<first_word: bigint, n_words: bigint, start_byte: bigint, end_byte: bigint>>"
_SPAN = pa.struct([(k, pa.int64()) for k in ("first_word", "n_words", "start_byte", "end_byte")])


def decontaminate(docs: DataFrame, benchmark: DataFrame, rules: Contamination = Contamination(), row: bool = False) -> DataFrame:
    """doc_id, n_words, removal spans (word and byte ranges), items with an occurrence, n_hit, contaminated.

    With ``row`` all columns of ``docs`` come along in a struct of that name.
    """
    sent, known, shortest = [], [np.zeros(0, np.uint64)], 0
    for items in blocks(benchmark, rules):
        phrases = Phrases(items, rules.window)
        if phrases.by_length:
            known.append(phrases.vocabulary)
            shortest = min([*phrases.by_length, *([shortest] if shortest else [])])
            if len(known) > 64:
                known = [np.unique(np.concatenate(known))]
            sent.append(docs.sparkSession.sparkContext.broadcast(phrases))
    all_words = docs.sparkSession.sparkContext.broadcast(Words(np.unique(np.concatenate(known))))

    def find(part):
        text = X.text_bytes(part.column("text"))
        words = X.find_words(text, X.ALNUM, lower=True)
        n, total = len(words.offs) - 1, len(words.starts)
        hit, items = np.zeros(total + 1, np.int32), [set() for _ in range(n)]
        if total and sent:
            h = X.hash_words(words)
            shard = Shard(h, words.offs, all_words.value.known(h), shortest, rules.sample)
            for block in sent if shard.index else ():
                for size, first, which, owners in shard.occurrences(block.value):
                    np.add.at(hit, first, 1)
                    np.add.at(hit, first + size, -1)
                    doc = np.searchsorted(words.offs, first, "right") - 1
                    for pair in np.unique(doc * len(owners) + which).tolist():
                        items[pair // len(owners)].update(owners[pair % len(owners)])
                if len(sent) > 1:
                    vars(block).pop("_value", None)  # a worker holds one block
        inside = np.cumsum(hit[:-1]) > 0
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        cut = words.offs[:-1]
        cut = cut[(cut > 0) & (cut < total)]
        begins[cut] = inside[cut]
        ends[cut - 1] = inside[cut - 1]
        b, e = np.flatnonzero(begins), np.flatnonzero(ends)
        doc = np.searchsorted(words.offs, b, "right") - 1
        values = [b - words.offs[doc], e + 1 - b, words.starts[b] - text.offs[doc], words.ends[e] - text.offs[doc]] if len(b) else [np.zeros(0, np.int64)] * 4
        offs = pa.array(np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=n))]).astype(np.int32))
        return [
            pa.array(words.counts.astype(np.int64)),
            pa.ListArray.from_arrays(offs, pa.StructArray.from_arrays([pa.array(v.astype(np.int64)) for v in values], fields=list(_SPAN))),
            pa.array([sorted(x) for x in items], pa.list_(pa.string())),
        ]

    found = X.map_texts(docs, lambda: find, f"n_words long, {SPANS}, items array<string>", row=row)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s.n_words)
    return found.withColumn("n_hit", hit).withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 100 >= F.col("n_words") * rules.percent))
