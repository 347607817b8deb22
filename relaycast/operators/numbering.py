"""One order over all rows, numbered, without one task that sees them all.

Rows are dealt into ranges of the whole composite key (so that many rows with one first key are split by the
next), sorted inside them, and numbered there as they are written; a range starts after the rows of those
before it, which is one row a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import stored

#: ``monotonically_increasing_id`` holds the partition above these bits and the row's place in it below.
_PLACE_BITS = 33


def numbered(rows: DataFrame, *order: Column | str, name: str = "place", start: int = 0) -> DataFrame:
    """``rows`` with ``name``, their place in ``order`` from ``start`` on.

    Nulls go where each key of ``order`` puts them. Rows equal in all keys are numbered in some order among
    themselves, so end with a key that tells them apart where that matters.
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    placed = stored(ranged, "numbered")
    part, at = F.shiftright("_id", _PLACE_BITS), F.col("_id").bitwiseAND((1 << _PLACE_BITS) - 1)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # one row a range
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    found = placed.withColumn("_part", part).join(F.broadcast(starts), "_part")  # one row a range
    return found.select(*rows.columns, (F.col("_start") + at + start).cast("long").alias(name))


def numbered_within(rows: DataFrame, keys: list[str], *order: Column | str, name: str = "place", start: int = 0) -> DataFrame:
    """The same inside each group of ``keys``: groups of any size, as a group starts at its least number in the whole order."""
    whole = stored(numbered(rows, *keys, *order, name="_whole"), "whole")
    least = whole.groupBy(*keys).agg(F.min("_whole").alias("_least"))
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    on = same[0]
    for s in same[1:]:
        on = on & s
    both = whole.alias("a").join(least.alias("b"), on)
    return both.select("a.*", (F.col("a._whole") - F.col("b._least") + start).cast("long").alias(name)).drop("_whole")


def running(rows: DataFrame, keys: list[str], place: str, span: int = 1_000_000, **totals: str) -> DataFrame:
    """Running totals in order of ``place`` (an existing number, distinct in each group of ``keys``), itself included.

    ``totals`` name what each column sums. Spans of places are summed first, so a window holds a span, not a group.
    """
    spanned = rows.withColumn("_span", F.floor(F.col(place) / span))
    sums = spanned.groupBy(*keys, "_span").agg(*(F.sum(c).alias(f"_{n}") for n, c in totals.items()))
    before = W.partitionBy(*keys).orderBy("_span").rowsBetween(W.unboundedPreceding, -1)  # a row a span
    starts = sums.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_span").alias("_s"), *(F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in totals))
    same = F.col("_span") == F.col("_s")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    inside = W.partitionBy(*keys, "_span").orderBy(place)
    own = spanned.withColumns({f"_in_{n}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for n, c in totals.items()})
    return own.join(starts, same).select(*rows.columns, *((F.col(f"_in_{n}") + F.col(f"_{n}")).alias(n) for n in totals))
