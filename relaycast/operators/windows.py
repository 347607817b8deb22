"""Data-anchored windows, causal statistics, islands."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def anchored_windows(items: DataFrame, length: int, keys: list[str] | None = None, at: str = "sol") -> DataFrame:
    """window, first_sol, last_sol for each run of ``keys``.

    A window starts at the first day that no earlier one holds and takes all days before start + length, so
    gaps are skipped. Only distinct days of a run are gathered, never its items. Undated items form one last
    window (-1, -1).
    """
    keys = keys or []
    days = items.groupBy(*keys).agg(F.array_sort(F.collect_set(at)).alias("days"), F.max(F.col(at).isNull()).alias("undated"))
    start = lambda s: F.element_at(s, -1)
    empty = F.array().cast("array<bigint>")
    starts = F.aggregate("days", empty, lambda s, x: F.when((F.size(s) == 0) | (x - start(F.when(F.size(s) == 0, F.array(x.cast("bigint"))).otherwise(s)) >= length), F.concat(s, F.array(x.cast("bigint")))).otherwise(s))
    dated = days.select(*keys, "days", "undated", starts.alias("starts"))
    within = F.transform("starts", lambda s, i: F.struct(i.cast("bigint").alias("window"), s.alias("first_sol"), F.array_max(F.filter("days", lambda x: (x >= s) & (x < s + length))).cast("bigint").alias("last_sol")))
    last = F.when(F.col("undated"), F.array(F.struct(F.size("starts").cast("bigint").alias("window"), F.lit(-1).cast("bigint").alias("first_sol"), F.lit(-1).cast("bigint").alias("last_sol")))).otherwise(F.array().cast("array<struct<window: bigint, first_sol: bigint, last_sol: bigint>>"))
    return dated.select(*keys, F.inline(F.concat(within, last)))


def with_windows(items: DataFrame, windows: DataFrame, keys: list[str] | None = None, at: str = "sol") -> DataFrame:
    """Items with the window that holds their day; a window table is a row a window, joined on day ranges."""
    keys = keys or []
    days = windows.filter("first_sol >= 0").select(*keys, "window", F.explode(F.sequence("first_sol", "last_sol")).alias("_day"))
    undated = windows.filter("first_sol < 0").select(*keys, F.col("window").alias("_last"))
    dated = items.join(days.withColumnRenamed("_day", at), [*keys, at], "left") if keys else items.join(days.withColumnRenamed("_day", at), at, "left")
    if keys:
        both = dated.join(undated, keys, "left")
    else:
        both = dated.join(F.broadcast(undated), F.lit(True), "left")  # one row at most
    return both.withColumn("window", F.when(F.col(at).isNull(), F.col("_last")).otherwise(F.col("window"))).drop("_last")


def causal_stats(items: DataFrame, value: str, by: str = "sol", keys: list[str] | None = None) -> DataFrame:
    """For each ``by``: count, mean and squared deviations (before_n, before_mean, before_m2) of all earlier ones (none of its own).

    Each ``by`` is summed about its own mean, and these about the first one's, so large values don't cancel.
    """
    keys = keys or []
    each = items.groupBy(*keys, by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), (F.var_pop(value) * F.count(value)).alias("m2"))
    w = W.partitionBy(*keys).orderBy(by)  # one row for each ``by``
    off = F.coalesce(F.col("mean") - F.col("shift"), F.lit(0.0))
    shifted = each.withColumn("shift", F.first("mean", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))).select(*keys, by, "n", "shift", (F.col("n") * off).alias("s"), (F.coalesce("m2", F.lit(0.0)) + F.col("n") * off * off).alias("ss"))
    before = w.rowsBetween(W.unboundedPreceding, -1)
    n, s, ss = (F.coalesce(F.sum(c).over(before), F.lit(0)) for c in ("n", "s", "ss"))
    summed = shifted.select(*keys, by, "shift", n.alias("before_n"), s.alias("_s"), ss.alias("_ss"))
    return summed.select(*keys, by, "before_n", (F.col("shift") + F.try_divide("_s", "before_n")).alias("before_mean"), F.greatest(F.lit(0.0), F.col("_ss") - F.coalesce(F.try_divide(F.col("_s") * F.col("_s"), "before_n"), F.lit(0.0))).alias("before_m2"))


def causal_z(value, n, mean, m2):
    """|x - mean| over the sample deviation of what came before; 0 with fewer than two; variance floor 1e-12."""
    return F.when(n < 2, F.lit(0.0)).otherwise(F.abs(value - mean) / F.sqrt(F.greatest(m2 / (n - 1), F.lit(1e-12))))


def islands(rows: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Runs of consecutive numbers: run_from, run_to."""
    w = W.partitionBy(*keys).orderBy(at)
    return rows.select(*keys, at).distinct().withColumn("_g", F.col(at) - F.row_number().over(w)).groupBy(*keys, "_g").agg(F.min(at).alias("run_from"), F.max(at).alias("run_to")).drop("_g")


def format_islands(runs: DataFrame, keys: list[str], universe: DataFrame, most: int = 8) -> DataFrame:
    """n_windows and text for each row of ``universe`` (keys, total): 'none', 'all N windows', or 'n of N windows:' and up to
    ``most`` runs as a, b or a–b, with how many more there are."""
    c = F.col
    text = F.when(c("run_from") == c("run_to"), c("run_from").cast("string")).when(c("run_to") - c("run_from") == 1, F.concat_ws(", ", c("run_from"), c("run_to"))).otherwise(F.concat_ws("–", c("run_from"), c("run_to")))
    nth = F.row_number().over(W.partitionBy(*keys).orderBy("run_from"))
    got = runs.withColumn("_k", nth).groupBy(*keys).agg(
        F.sum(c("run_to") - c("run_from") + 1).cast("long").alias("n"), F.count("*").alias("n_runs"),
        F.array_sort(F.collect_list(F.when(c("_k") <= most, F.struct("_k", text.alias("text"))))).alias("r"),
    )
    listed = F.array_join(F.transform("r", lambda x: x.text), ", ")
    more = F.when(c("n_runs") > most, F.concat(F.lit(", … (+"), (c("n_runs") - most).cast("string"), F.lit(" more runs)"))).otherwise("")
    said = F.when(c("n").isNull(), "none").when(c("n") == c("total"), F.concat(F.lit("all "), c("total").cast("string"), F.lit(" windows")))
    said = said.otherwise(F.concat(c("n").cast("string"), F.lit(" of "), c("total").cast("string"), F.lit(" windows: "), listed, more))
    return universe.join(got, keys, "left").select(*keys, F.coalesce("n", F.lit(0)).alias("n_windows"), said.alias("text"))


def running_total(rows: DataFrame, keys: list[str], by: str, cols: list[str]) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(by).rowsBetween(W.unboundedPreceding, 0)
    return rows.select("*", *(F.sum(c).over(w).alias(f"cum_{c}") for c in cols))
