"""Spelling variants: words one edit apart, grouped under the commoner form.

Of two words one edit apart, one half of the longer exact part is the same in both: the edit lies either behind
a word's first half or inside it. So each word goes to the bucket of its first half and to that of its last
half. A bucket builds the minimal acyclic automaton of its words (of the reversed words for last halves), whose
perfect-hash numbers name them; a word matches its half exactly and is completed with one error. A pair that
both directions find counts in the forward one alone. Only a word's count of near words and its best one leave
the bucket, not its pairs. Forms are followed to their last by pointer doubling.

Words are counted in chunks with numpy before they are shuffled. A bucket beyond its size is split in both
roles, words searched and words searching, and its parts meet as a grid.

Defined cases: a null text has no words; a null identifier counts as the empty string; repeated rows count
each; a word without near words has ``n_near`` 0 and itself as root; an empty table gives an empty result;
other columns are ignored. Words of any length are whole, at one numpy step a character of the longest.
"""

from __future__ import annotations

import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as X
from . import pieces as P
from ._automaton import Automaton, Strings
from ._store import stored


class Spelling(NamedTuple):
    min_chars: int = 5
    min_count: int = 3
    noise: int = 97  # an occurrence whose checksum this divides loses a character
    ratio: int = 2  # a form occurs at least so many times as often
    bucket: int = 60_000  # words of a bucket, on average


_ASCII_LETTER = X._table(lambda b: 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A)
_ONE = X._table(lambda b: b == 1)
#: From this length on, a word's checksum is left to zlib.
_LONG = 64


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


_CRC = _crc_table()


def letter_runs(text: X.Bytes) -> X.Words:
    """Maximal runs of A-Z, a-z and U+00C0 to U+00FF, with A-Z in lower case."""
    lead = text.data == 0xC3
    letter = _ASCII_LETTER[text.data] | lead
    letter[1:] |= lead[:-1]
    found = X.find_words(X.Bytes(letter.view(np.uint8), text.offs), _ONE)
    return found._replace(data=X.LOWER[text.data])


def checksums(words: X.Words, ids: list[bytes]) -> np.ndarray:
    """crc32 of ``<id>:<word>`` for every word."""
    prefix = np.array([zlib.crc32(i + b":") for i in ids], np.uint32)
    size = words.ends - words.starts
    crc = np.repeat(prefix, words.counts) ^ np.uint32(0xFFFFFFFF)
    order = np.argsort(-size, kind="stable")
    live = np.searchsorted(-size[order], -np.arange(1, min(int(size.max(initial=0)), _LONG) + 1), "right")
    for j, n in enumerate(live.tolist()):
        own = order[:n]
        c = crc[own]
        crc[own] = _CRC[(c ^ words.data[words.starts[own] + j]) & 255] ^ (c >> np.uint32(8))
    crc ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(size > _LONG).tolist():
        crc[i] = zlib.crc32(words.data[words.starts[i] + _LONG : words.ends[i]], int(crc[i]))
    return crc


def chunk_words(part: pa.RecordBatch, rule: Spelling) -> pa.RecordBatch:
    """word, n of a chunk, the dropped characters already gone."""
    words = letter_runs(X.text_bytes(part.column("text")))
    ids = [b"" if i is None else str(i).encode() for i in part.column("doc_id").to_pylist()]
    hit = checksums(words, ids) % np.uint32(rule.noise) == 0
    crc = checksums(words, ids)[hit] if hit.any() else np.zeros(0, np.uint32)
    edited = []
    for a, b, h in zip(words.starts[hit].tolist(), words.ends[hit].tolist(), crc.tolist(), strict=True):
        word = words.data[a:b].tobytes().decode()
        at = h % len(word)
        edited.append((word[:at] + word[at + 1 :]).encode())
    edited = [w for w in edited if len(w.decode()) >= rule.min_chars]
    chars = (words.ends - words.starts) - X.per_doc(words.data == 0xC3, np.stack([words.starts, words.ends], 1).ravel())[::2] if len(words.starts) else words.starts
    stay = np.flatnonzero(~hit & (chars >= rule.min_chars))
    size = (words.ends - words.starts)[stay]
    plain = P.binaries(P.gather(words.data, words.starts[stay], size), np.concatenate([[0], np.cumsum(size)]))
    counts = pc.value_counts(pa.concat_arrays([plain, pa.array(edited, pa.large_binary())]))
    return pa.RecordBatch.from_arrays([counts.field("values").cast(pa.large_string()).cast(pa.string()), counts.field("counts").cast(pa.int64())], names=["word", "n"])


def vocabulary(docs: DataFrame, rule: Spelling) -> DataFrame:
    def count(batches):
        for batch in batches:
            for part in X.chunks(batch):
                yield chunk_words(part, rule)

    return docs.select("doc_id", "text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= rule.min_count)


def search(block: pa.Table) -> pa.Table:
    """For each word that asks in this bucket: word, n, how many near words it has here and the best of them."""
    block = block.combine_chunks()
    back = bool(len(block)) and block.column("back")[0].as_py()
    own = pc.is_in(block.column("role"), value_set=pa.array(["asks", "both"]))
    held = pc.is_in(block.column("role"), value_set=pa.array(["held", "both"]))
    asking = block.filter(own).select(["word", "n"])
    known = block.filter(held).group_by("word").aggregate([("n", "max")])
    names, counts = known.column("word").combine_chunks(), known.column("n_max").to_numpy()
    words, strings = Strings.of_latin(asking.column("word").combine_chunks()), Strings.of_latin(names)
    # By code points, for ties; the automaton has its own order.
    place = np.empty(len(strings), np.int64)
    place[strings.order()] = np.arange(len(strings))
    half = words.size // 2
    inside = strings.reversed() if back else strings
    order = inside.order()
    machine = Automaton(inside.take(order))
    best, n_near = np.full(len(words), -1, np.int64), np.zeros(len(words), np.int64)
    asked = words.reversed() if back else words
    for lo in range(0, len(words), 20_000):
        some = np.arange(lo, min(lo + 20_000, len(words)))
        who, number = machine.one_error(asked.take(some), (words.size - half if back else half)[some])
        who, found = some[who], order[number]
        if back:  # one that has the first half too is the forward bucket's
            mine = ~_same_start(words, who, strings, found, half[who])
            who, found = who[mine], found[mine]
        n_near += np.bincount(who, minlength=len(words))
        rank = np.lexsort((place[found], -counts[found], who))
        who, found = who[rank], found[rank]
        first = np.ones(len(who), bool)
        first[1:] = who[1:] != who[:-1]
        best[who[first]] = found[first]
    none = pa.array(best < 0)
    near = names.take(pa.array(np.maximum(best, 0), mask=best < 0)) if len(names) else pa.nulls(len(words), pa.string())
    near_n = pa.array(counts[np.maximum(best, 0)] if len(names) else best, mask=np.asarray(none)).cast(pa.int64())
    return pa.table([asking.column("word"), asking.column("n"), pa.array(n_near), near, near_n], names=["word", "n", "n_near", "near", "near_n"])


def _same_start(a: Strings, i: np.ndarray, b: Strings, j: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether a[i] and b[j] begin with the same ``size`` bytes."""
    same = b.size[j] >= size
    some = np.flatnonzero(same & (size > 0))
    same[some] = P._same_bytes(a.data, a.offs[:-1][i[some]], b.data, b.offs[:-1][j[some]], size[some])
    return same


def _dealt(words: DataFrame, rule: Spelling) -> DataFrame:
    """Each word under the halves it asks for and under those by which others ask for it."""
    size = F.char_length("word")
    records = []
    for back, k, role in (
        # A word of l characters keeps l // 2 in front; neighbours have l - 1 to l + 1 characters.
        (False, "l div 2", "both"),
        (False, "if(l % 2 = 0, l div 2 - 1, l div 2 + 1)", "held"),
        (True, "l - l div 2", "both"),
        (True, "if(l % 2 = 0, l div 2 + 1, l div 2)", "held"),
    ):
        text = f"substring(word, l - ({k}) + 1)" if back else f"substring(word, 1, {k})"
        records.append(F.struct(F.lit(back).alias("back"), F.expr(text).alias("half"), F.lit(role).alias("role")))
    return words.withColumn("l", size).select("word", "n", F.explode(F.array(*records)).alias("x")).select("word", "n", "x.*")


def near_words(words: DataFrame, rule: Spelling) -> DataFrame:
    """word, n, n_near, and the near word of largest n (``near``, ``near_n``), for a stored table word, n."""
    buckets = max(1, -(-words.count() * 2 // rule.bucket))
    dealt = _dealt(words, rule).select("word", "n", "back", F.pmod(F.xxhash64("half"), F.lit(buckets)).alias("bucket"), "role")
    full = dealt.groupBy("back", "bucket").count().select("back", "bucket", F.ceil(F.col("count") / (rule.bucket * 4)).cast("int").alias("parts"))
    split = dealt.join(full.filter("parts > 1"), ["back", "bucket"], "left").na.fill(1, ["parts"])
    # A bucket of several parts is a grid: a word asks in a row of it, and is held in a column.
    own, every = F.pmod(F.xxhash64("word"), "parts").cast("int"), F.expr("sequence(0, parts - 1)")
    cell = lambda role, row, column: F.struct(F.lit(role).alias("role"), row.alias("row"), column.alias("column"))
    asks, held = F.transform(every, lambda c: cell("asks", own, c)), F.transform(every, lambda r: cell("held", r, own))
    cells = F.when(F.col("parts") == 1, F.array(F.struct(F.col("role"), F.lit(0).alias("row"), F.lit(0).alias("column")))).when(F.col("role") == "held", held).otherwise(F.concat(asks, held))
    gridded = split.select("word", "n", "back", "bucket", F.explode(cells).alias("x")).select("word", "n", "back", "bucket", "x.*")
    found = gridded.groupBy("back", "bucket", "row", "column").applyInArrow(search, "word string, n long, n_near long, near string, near_n long")
    best = F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("less"), F.col("near")))).alias("best")
    return found.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best).select("word", "n", "n_near", "best.near", (-F.col("best.less")).alias("near_n"))


def roots(linked: DataFrame) -> DataFrame:
    """word, root for a table word, form without cycles: pointers double until none moves."""
    to = stored(linked.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = to.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stored(to.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if not moved.filter("moved").take(1):
            return to
        to = moved.select("word", "root")


def spelling_variants(docs: DataFrame, rule: Spelling = Spelling()) -> DataFrame:
    """word, n, n_near, form, form_n, root for every word of at least ``min_chars`` characters and ``min_count`` occurrences."""
    words = stored(vocabulary(docs, rule), "words")
    near = near_words(words, rule)
    above = F.col("near_n") >= rule.ratio * F.col("n")
    found = stored(near.select("word", "n", "n_near", F.when(above, F.col("near")).alias("form"), F.when(above, F.col("near_n")).alias("form_n")), "forms")
    last = roots(found.filter("form is not null").select("word", "form"))
    return found.join(last, "word", "left").withColumn("root", F.coalesce("root", "word"))
