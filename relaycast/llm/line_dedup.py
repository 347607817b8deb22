"""Line dedup by winnowing over line hashes, in DataFrame functions alone.

1. A text's lines that hold a word are hashed. Of every window of two lines the one with the smaller hash (the
   later one of equals) is a fingerprint, so texts that share a window share its fingerprint; a line of
   ``alone`` words or more is a run by itself and always one.
2. Fingerprints join by hash; those that stand in one place only are done, which is most of a corpus.
3. A joined fingerprint is extended to the line before and after it, wherever it is that window's minimum, and
   each extended window is tied to its own first occurrence (by identifier, then place), never to other ones.
   So a fingerprint whose first place has other neighbours loses nothing, and no pairs are made within a group.
4. Windows that stand earlier chain into runs, blank lines between included, and go. Any run of two lines or
   more, or one long line, that stands earlier anywhere consists of such windows: exactly these lines go, and
   the first occurrence of every window stays.

Lines are compared by 64-bit hashes. A shorter line that is repeated alone stays. Counts and first occurrences
combine before their shuffle, are written, and are joined back with one row a key, so a very common line is a
skew that adaptive execution splits; work is linear in lines, also for a text of one line repeated.

Defined cases: identifiers are of any integer type, others are an error; null texts stay null, empty ones empty; lines without a word are no part of a run; rows of one
identifier with different texts are documents of their own, ordered by the text's hash; equal rows are edited
alike; a null identifier sorts first; an empty table gives no rows; other columns come along only with ``row``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import long_ids, stored

NO_ID = -(1 << 63)


@dataclass(frozen=True)
class Lines:
    alone: int = 20  # words of a line that is a run by itself


def _identified(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64("text").alias("text_hash"))


def hashed_lines(docs: DataFrame, p: Lines) -> DataFrame:
    """id, text_hash, at (numbers of the lines with a word), h (their hashes), long (which are runs); one row for equal rows."""
    split = _identified(docs).filter("text is not null").select("id", "text_hash", F.split("text", "\n", -1).alias("lines"))
    inked = split.withColumn("at", F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: F.get("lines", i).rlike(r"[^\x20\x09-\x0D]")))
    hashed = inked.select("id", "text_hash", "at", F.transform("at", lambda i: F.xxhash64(F.get("lines", i))).alias("h"), F.transform("at", lambda i: F.regexp_count(F.get("lines", i), F.lit(r"[^\x20\x09-\x0D]+")) >= p.alone).alias("long"))
    return hashed.dropDuplicates(["id", "text_hash"])


def fingerprints(lines: DataFrame) -> DataFrame:
    """id, text_hash, place, h, long, and for the windows before and after of which it is the minimum: the other
    line's hash (``left``, ``right``) and the line numbers ``before``, ``here``, ``after``."""

    def one(i):
        h, left, right = F.get("h", i), F.get("h", i - 1), F.get("h", i + 1)
        return F.struct(
            i.alias("place"), h.alias("h"), F.get("long", i).alias("long"), F.when(h <= left, left).alias("left"), F.when(h < right, right).alias("right"),
            F.get("at", i - 1).alias("before"), F.get("at", i).alias("here"), F.get("at", i + 1).alias("after"),
        )

    some = lines.filter(F.size("h") > 0)
    each = some.select("id", "text_hash", F.explode(F.transform(F.sequence(F.lit(0), F.size("h") - 1), one)).alias("f")).select("id", "text_hash", "f.*")
    return each.filter("long or left is not null or right is not null")


def repeated_runs(found: DataFrame) -> DataFrame:
    """id, text_hash, runs of line numbers [from, to] of the windows and long lines that stand earlier."""
    # An aggregate inside a join's stage keeps adaptive execution from splitting a hot key; a written table doesn't.
    many = stored(found.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h"), "many")
    joined = found.join(many.hint("merge"), "h")

    def extended(when, run, place, start, to):
        return F.when(when, F.struct(F.xxhash64(*run).alias("key"), place.alias("place"), start.alias("from"), to.alias("to")))

    c = F.col
    sides = F.array(
        extended(c("left").isNotNull(), ("left", "h"), c("place") - 1, c("before"), c("here")),
        extended(c("right").isNotNull(), ("h", "right"), c("place"), c("here"), c("after")),
        extended(c("long"), ("h",), c("place"), c("here"), c("here")),
    )
    each = stored(joined.select("id", "text_hash", F.explode(F.array_compact(sides)).alias("w")).select("id", "text_hash", "w.*"), "repeats")
    first = stored(each.groupBy("key").agg(F.min(F.struct("id", "text_hash", "place")).alias("f"), F.count("*").alias("n")).filter("n > 1").select("key", "f"), "first")
    again = each.join(first.hint("merge"), "key").filter(F.struct("id", "text_hash", "place") != F.col("f"))
    return again.groupBy("id", "text_hash").agg(F.collect_list(F.struct("from", "to")).alias("runs"))


def line_dedup(docs: DataFrame, p: Lines = Lines(), row: bool = False) -> DataFrame:
    """doc_id, n_lines, n_removed, text without later repeated runs, for every document; with ``row`` its other columns."""
    docs = long_ids(docs)
    gone = repeated_runs(fingerprints(stored(hashed_lines(docs, p), "lines")))
    source = _identified(docs)
    if row:
        source = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row")).select("row", F.col("row.doc_id").alias("doc_id"), F.col("row.text").alias("text"))
        source = source.withColumn("id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))).withColumn("text_hash", F.xxhash64("text"))
    found = source.join(gone, ["id", "text_hash"], "left").withColumn("lines", F.split("text", "\n", -1))
    removed = F.array_distinct(F.flatten(F.transform("runs", lambda r: F.sequence(r["from"], r["to"]))))
    found = found.withColumn("removed", F.coalesce(removed, F.array().cast("array<int>")))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "removed"), lambda i: F.get("lines", i))
    text = F.when(F.size("removed") == 0, F.col("text")).otherwise(F.array_join(kept, "\n"))
    return found.select("doc_id", F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_lines"), F.size("removed").cast("long").alias("n_removed"), text.alias("kept_text"), *(["row"] if row else []))
