"""Source divergence audit: how the word use of each source departs from other sources and from its language.

A byte-level tokenizer finds terms in the concatenated UTF-8 buffers of an Arrow batch with a lookup table over
bytes; slices are grouped by their xxhash and each is compared byte by byte with its group's first, so two
strings under one hash stay apart. A chunk's counts by (language, source, term) leave Python already summed,
Spark adds them up, and the kept terms' cells are dealt into column blocks of bounded size. In a block the
sources are rows of a CSR matrix of exact integer weights, and the distances of one row to all later ones are
sums over its neighbours' slices (``reduceat``); blocks add up to the distances of whole languages.

Defined cases: a null text, language or source counts as the empty string; every language and source that
occurs has its group, without terms too; a language without kept terms has distance 0 between its sources and
no term rows; a lone source has no pair rows; ties go by the item's bytes; repeated rows are documents of
their own; other columns, whatever they are called, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import _text as X
from . import pieces as P
from ._store import stored

#: Terms are runs of ASCII letters and of every character from U+0080.
TERM = X._table(lambda b: b >= 0x80 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A)


class Audit(NamedTuple):
    min_docs: int = 30  # a language keeps the terms of at least so many of its documents
    added: int = 5  # to each count
    scale: int = 1_000_000_000
    top: int = 50  # terms a group
    block_cells: int = 20_000  # stored cells of a column block, on average, or as many as it makes pairs, whichever is more
    most_cells: int = 2_000_000  # but no more than these


def group_slices(words: X.Words, digest: Callable = xxhash.xxh3_64_intdigest) -> tuple[np.ndarray, np.ndarray]:
    """The number of each slice's string, and one slice of each string."""
    raw = memoryview(np.ascontiguousarray(words.data))
    hashes = np.fromiter((digest(raw[a:b]) for a, b in zip(words.starts.tolist(), words.ends.tolist(), strict=True)), np.uint64, len(words.starts))
    _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
    size = words.ends - words.starts
    same = size == size[first[which]]
    alike = np.flatnonzero(same)
    same[alike] = P._same_bytes(words.data, words.starts[alike], words.data, words.starts[first[which[alike]]], size[alike])
    others: dict[bytes, int] = {}
    found: list[int] = []
    for i in np.flatnonzero(~same).tolist():  # another string under the same hash
        string = raw[words.starts[i] : words.ends[i]].tobytes()
        if string not in others:
            others[string] = len(first) + len(found)
            found.append(i)
        which[i] = others[string]
    return which, np.concatenate([first, np.array(found, first.dtype)])


def chunk_counts(part: pa.RecordBatch, digest: Callable = xxhash.xxh3_64_intdigest) -> pa.RecordBatch:
    """lang, source, term, n, n_docs of a chunk, and a row with a null term for each group in it."""
    lang, source = (pc.fill_null(part.column(c), "").cast(pa.string()).dictionary_encode() for c in ("lang", "source"))
    of_doc, group = np.unique(lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy(), return_inverse=True)
    words = X.find_words(X.text_bytes(part.column("text")), TERM, lower=True)
    which, first = group_slices(words, digest)
    many = max(len(first), 1)
    in_doc, times = np.unique(words.docs() * many + which, return_counts=True)
    cell = group[in_doc // many] * many + in_doc % many
    order = np.argsort(cell, kind="stable")
    cells, at = np.unique(cell[order], return_index=True)
    n = np.add.reduceat(times[order], at) if len(at) else np.zeros(0, np.int64)
    n_docs = np.diff(at, append=len(cell))
    size = (words.ends - words.starts)[first]
    strings = P.binaries(P.gather(words.data, words.starts[first], size), np.concatenate([[0], np.cumsum(size)])).cast(pa.large_string()).cast(pa.string())
    groups = np.concatenate([cells // many, np.arange(len(of_doc))])
    none = np.zeros(len(of_doc), np.int64)
    return pa.RecordBatch.from_arrays(
        [
            lang.dictionary.take(pa.array(of_doc[groups] // len(source.dictionary))),
            source.dictionary.take(pa.array(of_doc[groups] % len(source.dictionary))),
            pa.concat_arrays([strings.take(pa.array(cells % many)), pa.nulls(len(of_doc), pa.string())]),
            pa.array(np.concatenate([n, none]).astype(np.int64)),
            pa.array(np.concatenate([n_docs, none]).astype(np.int64)),
        ],
        names=["lang", "source", "term", "n", "n_docs"],
    )


def _count(batches):
    for batch in batches:
        for part in X.chunks(batch):
            yield chunk_counts(part)


def divergences(starts: np.ndarray, cols: np.ndarray, values: np.ndarray, base: np.ndarray, width: int) -> list[np.ndarray]:
    """For each row of a CSR matrix: the sums over all columns of the absolute differences to each later row.

    A cell that isn't stored holds its row's ``base``. A row is spread out once; against each later row's base
    alone its sum comes from sorted prefix sums, and that row's stored cells then correct theirs.
    """
    rows, size = len(base), np.diff(starts)
    own_base, out = np.repeat(base, size), []
    for g in range(rows - 1):
        dense = np.full(width, base[g], np.int64)
        dense[cols[starts[g] : starts[g + 1]]] = values[starts[g] : starts[g + 1]]
        ordered = np.sort(dense)
        below = np.concatenate([[0], np.cumsum(ordered)])
        later = base[g + 1 :]
        at = np.searchsorted(ordered, later)
        sums = later * at - below[at] + (below[-1] - below[at]) - later * (width - at)
        low = starts[g + 1]
        spread = dense[cols[low:]]
        change = np.abs(spread - values[low:]) - np.abs(spread - own_base[low:])
        filled = np.flatnonzero(size[g + 1 :])
        if len(filled):
            sums[filled] += np.add.reduceat(change, starts[g + 1 : -1][filled] - low)
        out.append(sums)
    return out


def _block(block: pa.Table) -> pa.Table:
    """Sums of a column block for all pairs of a language's sources (each source has a row with a null term)."""
    block = block.combine_chunks()
    is_group = pc.is_null(block.column("term"))
    groups, cells = block.filter(is_group).sort_by("source"), block.filter(pc.invert(is_group))
    names = groups.column("source").combine_chunks()
    base = groups.column("p").to_numpy()
    row = pc.index_in(cells.column("source"), value_set=names).to_numpy()
    terms = cells.column("term").combine_chunks()
    terms = terms.dictionary_encode() if len(terms) else pa.array([], pa.string()).dictionary_encode()
    order = np.lexsort((terms.indices.to_numpy(), row))
    starts = np.searchsorted(row[order], np.arange(len(names) + 1))
    sums = divergences(starts, terms.indices.to_numpy()[order], cells.column("p").to_numpy()[order], base, len(terms.dictionary))
    later = [np.arange(g + 1, len(names)) for g in range(len(names) - 1)]
    a = np.repeat(np.arange(len(later)), [len(x) for x in later])
    flat = lambda parts: np.concatenate([np.zeros(0, np.int64), *parts]).astype(np.int64)
    lang = groups.column("lang").combine_chunks().take(pa.array(np.zeros(len(a), np.int64)))
    return pa.table([lang, names.take(pa.array(a.astype(np.int64))), names.take(pa.array(flat(later))), pa.array(flat(sums))], names=["lang", "source", "item", "value"])


def source_audit(docs: DataFrame, audit: Audit = Audit()) -> DataFrame:
    """lang, source, part (``pair`` or ``term``), item, value, rank."""
    read = docs.select("lang", "source", "text").mapInArrow(_count, "lang string, source string, term string, n long, n_docs long")
    cells = stored(read.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs")), "cells")
    of_lang = cells.filter("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("n_docs").alias("docs")).filter(F.col("docs") >= audit.min_docs)
    kept = stored(cells.filter("term is not null").join(of_lang.drop("docs"), ["lang", "term"]).select("lang", "source", "term", "n", "lang_n"), "kept")
    # Totals of groups, and of languages from their groups: a language's kept terms are counted once each.
    terms = kept.select("lang", "term", "lang_n").distinct().groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"))
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("cells"))
    groups = cells.filter("term is null").select("lang", "source").join(sums, ["lang", "source"], "left").join(terms, "lang", "left").na.fill(0, ["total", "cells", "v", "lang_total"])
    wide = F.least(F.greatest(F.count("*") * F.count("*"), F.lit(audit.block_cells)), F.lit(max(audit.most_cells, audit.block_cells)))
    size = groups.groupBy("lang").agg(F.greatest(F.lit(1), F.ceil(F.sum("cells") / wide)).cast("int").alias("blocks"))
    groups = stored(groups.join(size, "lang"), "groups")

    def weight(n, total):
        """1 + floor(scale * (n + added) / (total + added * v)), in decimals; 0 where no term is kept."""
        below = F.col(total) + audit.added * F.col("v")
        share = F.call_function("div", F.lit(audit.scale).cast("decimal(12,0)") * (n + audit.added).cast("decimal(20,0)"), below.cast("decimal(20,0)"))
        return F.when(F.col("v") > 0, 1 + share).otherwise(F.lit(0)).cast("long")

    weighed = kept.join(groups, ["lang", "source"]).select("lang", "source", "term", "blocks", weight(F.col("n"), "total").alias("p"), weight(F.col("lang_n"), "lang_total").alias("q"))
    by_rank = lambda *order: F.row_number().over(W.partitionBy("lang", "source").orderBy(*order))
    order = (F.desc("value"), F.asc("item"))
    above = weighed.filter("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    best = above.withColumn("rank", by_rank(*order)).filter(F.col("rank") <= audit.top)
    rows = weighed.select("lang", F.pmod(F.xxhash64("term"), "blocks").cast("int").alias("block"), "source", "term", "p")
    bases = groups.select("lang", F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"), "source", F.lit(None).cast("string").alias("term"), weight(F.lit(0), "total").alias("p"))
    parts = rows.unionByName(bases).groupBy("lang", "block").applyInArrow(_block, "lang string, source string, item string, value long")
    pairs = parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = pairs.select("lang", F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("x"), "value")
    ranked = both.select("lang", "x.source", "x.item", "value").withColumn("rank", by_rank(*order))
    out = ("lang", "source", "part", "item", "value", "rank")
    return ranked.withColumn("part", F.lit("pair")).select(*out).unionByName(best.withColumn("part", F.lit("term")).select(*out))
