"""Exact order statistics of a whole column, by histograms that descend into one range.

A pass counts equal ranges between two bounds, with each range's least and largest value; the next goes into the
range that holds the wanted place, between those values. Only a pass's counts, a bounded number of rows, ever
meet in one place. A range of few rows, or of one value, ends the descent.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ranges of a pass, and the distinct values from which a last pass names them all.
RANGES, FEW = 4096, 4096


def kth(rows: DataFrame, column: str, k: int) -> float:
    """The value at place ``k`` (from 0) of the ascending, non-null values; NaN stands after all numbers."""
    x = F.col(column).cast("double")
    own = rows.select(x.alias("x")).filter("x is not null")
    inf = float("inf")
    finite = ~F.isnan("x") & (F.abs("x") < inf)
    n, low, high, fewer, more, nan = own.agg(
        F.count("*"), F.min(F.when(finite, F.col("x"))), F.max(F.when(finite, F.col("x"))), F.count_if(F.col("x") == -inf), F.count_if((F.col("x") == inf) & ~F.isnan("x")), F.count_if(F.isnan("x"))
    ).first()
    if not 0 <= k < n:
        raise ValueError(f"no place {k} among {n} values")
    if k < fewer:
        return -inf
    if k >= n - nan:
        return math.nan
    if k >= n - nan - more:
        return inf
    k, inside = k - fewer, n - fewer - more - nan
    own = own.filter(finite)
    while low < high and inside > FEW:
        within = own.filter((F.col("x") >= low) & (F.col("x") <= high))
        # Halves keep the width finite for bounds of opposite sign; every step is monotone, so ranges are too.
        share = (F.col("x") / 2 - low / 2) / (high / 2 - low / 2) if high / 2 > low / 2 else (F.col("x") > low).cast("double")
        ranges = F.least(F.floor(share * RANGES), F.lit(RANGES - 1)).cast("int")
        counts = within.groupBy(ranges.alias("r")).agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).orderBy("r").collect()
        for r in counts:  # at most RANGES rows
            if k < r.n:
                low, high, inside = r.low, r.high, r.n
                break
            k -= r.n
    if low == high:
        return low
    last = own.filter((F.col("x") >= low) & (F.col("x") <= high)).groupBy("x").agg(F.count("*").alias("n")).orderBy("x").collect()
    for r in last:  # at most FEW rows
        if k < r.n:
            return r.x
        k -= r.n
    raise RuntimeError("the rows changed between two passes; store them first")


def median(rows: DataFrame, column: str) -> float | None:
    """The median of the non-null values (the mean of the middle two); null without values, NaN if any value is."""
    n, nan = rows.select(F.col(column).cast("double").alias("x")).filter("x is not null").agg(F.count("*"), F.count_if(F.isnan("x"))).first()
    if not n:
        return None
    if nan:
        return math.nan
    low = kth(rows, column, (n - 1) // 2)
    return low if n % 2 else low / 2 + kth(rows, column, n // 2) / 2
