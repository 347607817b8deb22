"""Published figures in many documents: marked ones compared with their source, unmarked ones found.

A mark ``<!--@KEY-->`` stands behind a figure. What is written before it, as many words as the figure has, must be
the figure. Where a distinctive figure stands without a mark is found by one pass of an automaton over all figures
(Aho-Corasick), which skips what marks cover; a figure inside a longer number is none.
"""

from __future__ import annotations

import re
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import stored, with_workers

#: Figures (UTF-8 bytes and a constant each) of one automaton; more figures are more automata, a pass each.
AUTOMATON_BYTES = 8 << 20
# A mark, and the length from which a figure is distinctive.
_MARK = re.compile(r"<!--@[A-Z0-9_]+-->")
LEAST = 5


def marked(docs: DataFrame, figures: DataFrame, id_: str = "doc_id") -> DataFrame:
    """Each mark: id, line, key, written, text, source, problem (``unknown figure``, ``mismatch`` or null)."""
    lines = docs.filter(F.contains("text", F.lit("<!--@"))).select(id_, F.posexplode(F.split("text", r"\n")).alias("line", "_line")).filter(F.contains("_line", F.lit("<!--@")))
    each = lines.select(id_, (F.col("line") + 1).cast("long").alias("line"), F.posexplode(T.markers(F.col("_line"))).alias("nth", "_m")).select(id_, "line", "nth", "_m.key", F.col("_m.text").alias("_before"))
    known = figures.select(F.col("key").alias("_key"), "text", "source")
    joined = each.join(known, F.col("key") == F.col("_key"), "left")
    written = F.when(F.col("_key").isNotNull(), T.last_words(F.col("_before"), F.col("text")))
    problem = F.when(F.col("_key").isNull(), "unknown figure").when(~written.eqNullSafe(F.col("text")), "mismatch")
    return joined.select(id_, "line", F.col("nth").cast("long").alias("nth"), "key", written.alias("written"), "text", "source", problem.alias("problem"))


def distinctive(figures: DataFrame) -> DataFrame:
    """key, text of figures that prove something where they stand: long enough, with a digit, not zero; of equal texts the least key."""
    own = figures.filter((F.char_length("text") >= LEAST) & F.col("text").rlike("[0-9]") & (F.coalesce("value", F.lit(1.0)) != 0))
    return own.groupBy("text").agg(F.min("key").alias("key")).select("key", "text")


def covered(text: str) -> list[tuple[int, int]]:
    """Spans that marks cover: each with what stands before it, back to the nearest angle bracket."""
    spans, at = [], 0
    for m in _MARK.finditer(text):
        begin = max(at, text.rfind("<", at, m.start()) + 1, text.rfind(">", at, m.start()) + 1)
        spans.append((begin, m.end()))
        at = m.end()
    return spans


def occurrences(text: str, automaton) -> list[tuple[int, str]]:
    """(place, figure) of every unmarked figure that isn't part of a longer number, in order of places."""
    found = []
    for last, figure in automaton.iter(text):
        at, after = last - len(figure) + 1, last + 1
        if not (at and (text[at - 1] == "." or text[at - 1].isdecimal()) or after < len(text) and text[after].isdecimal()):
            found.append((at, figure))
    spans, k, out = covered(text), 0, []
    for at, figure in sorted(found):
        while k < len(spans) and spans[k][1] <= at:
            k += 1
        if k == len(spans) or spans[k][0] >= at + len(figure):
            out.append((at, figure))
    return out


class Masks:
    """Places in texts that look like some figure: its digits as zeros, where its first run of digits is a whole run.

    That run can't go on in the text, as a figure inside a longer number is none, so each run of a text is looked at once
    for every (place of the first digit, length).
    """

    _RUN, _ZERO = re.compile(r"\d+"), str.maketrans("123456789", "0" * 9)

    def __init__(self, masks: list[str]):
        self.by: dict[tuple[int, int], set[str]] = {}
        for m in masks:
            self.by.setdefault((self._RUN.search(m).start(), len(m)), set()).add(m)

    def iter(self, text: str):
        zeros = text.translate(self._ZERO)
        for run in self._RUN.finditer(text):
            for (before, length), masks in self.by.items():
                at = run.start() - before
                if at >= 0 and zeros[at : at + length] in masks:
                    yield at + length - 1, text[at : at + length]


def unmarked(docs: DataFrame, figures: DataFrame, id_: str = "doc_id", limit: int = AUTOMATON_BYTES) -> DataFrame:
    """Each unmarked occurrence of a distinctive figure: id, key, figure, at (from 0), line (from 1).

    One pass over the documents finds what looks like a figure, and a join which are figures. Where the looks (figures with
    their digits as zeros) come to more than ``limit`` bytes, figures are dealt into sets of about that size instead; a
    set is broadcast, a task builds its automaton once, and each set is a pass of its own over the documents.
    """
    spark = with_workers(docs.sparkSession)
    own = stored(distinctive(figures), "figures")
    keys = own.select(F.col("text").alias("figure"), "key")
    masks = own.select(F.regexp_replace("text", "[1-9]", "0").alias("text")).distinct()
    if masks.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0] <= limit:
        looks = spark.sparkContext.broadcast([r.text for r in masks.collect()])  # at most ``limit`` bytes
        return _search(docs, looks, id_, True).join(keys, "figure").select(id_, "key", "figure", "at", "line")
    size = own.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    sets = max(1, -(-size // limit))
    found = None
    for k in range(sets):
        some = own.filter(F.pmod(F.xxhash64("text"), F.lit(sets)) == k) if sets > 1 else own
        texts = spark.sparkContext.broadcast([r.text for r in some.select("text").collect()])  # at most about ``limit`` bytes
        part = _search(docs, texts, id_)
        found = part if found is None else found.unionByName(part)
    return found.join(keys, "figure").select(id_, "key", "figure", "at", "line")


def _search(docs: DataFrame, texts, id_: str, looks: bool = False) -> DataFrame:
    kind = docs.schema[id_].dataType.simpleString()

    def run(batches):
        if looks:
            automaton = Masks(texts.value)
        else:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for t in texts.value:
                automaton.add_word(t, t)
            if not len(automaton):
                return
            automaton.make_automaton()
        for batch in batches:
            rows, figure, at, line = [], [], [], []
            for i, text in enumerate(batch.column("text")):
                text, seen, lines = text.as_py(), 0, 1
                for place, f in occurrences(text, automaton) if text else ():
                    lines += text.count("\n", seen, place)
                    seen = place
                    rows.append(i)
                    figure.append(f)
                    at.append(place)
                    line.append(lines)
            yield pa.RecordBatch.from_arrays([batch.column(id_).take(pa.array(rows, pa.int64())), pa.array(figure, pa.string()), pa.array(at, pa.int64()), pa.array(line, pa.int64())], names=[id_, "figure", "at", "line"])

    return docs.select(id_, "text").mapInArrow(run, f"{id_} {kind}, figure string, at long, line long")
