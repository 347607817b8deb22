"""Ranking metrics over whole tables, without gathering them, or one key of them, in one task.

Rows are numbered in one order over the whole table (score, then label, then index, so that ties of any number are
split), and running totals come from spans of that number. AUC combines rows by score before anything is ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numbering import numbered, numbered_within, running


def _numbered(df: DataFrame, keys: list[str], *order: Column | str, name: str = "rank") -> DataFrame:
    return numbered_within(df, keys, *order, name=name, start=1) if keys else numbered(df, *order, name=name, start=1)


def pessimistic_rank(df: DataFrame, keys: list[str] | None = None, score: str = "s", label: str = "y", idx: str = "idx") -> DataFrame:
    """rank (1 is best; ties put negatives first, then the smaller idx) and tp, positives up to it."""
    keys = keys or []
    ranked = _numbered(df, keys, F.desc(score), F.asc(label), F.asc(idx))  # read from files, however often
    return running(ranked, keys, "rank", tp=label).withColumn("tp", F.col("tp").cast("long"))


def _checked(k: int) -> int:
    if k <= 0:
        raise ValueError("k must be positive")
    return k


def precision_at_k(ranked: DataFrame, ks: list[int], keys: list[str] | None = None) -> DataFrame:
    """k, precision; k beyond the table counts as its size; k <= 0 is an error."""
    for k in ks:
        _checked(k)
    return _at_k(ranked, ks, keys, lambda hits, k, n, p: hits / F.least(F.lit(k), n), "precision")


def recall_at_k(ranked: DataFrame, ks: list[int], keys: list[str] | None = None) -> DataFrame:
    """k, recall; k < 1 counts as 1."""
    return _at_k(ranked, [max(1, k) for k in ks], keys, lambda hits, k, n, p: F.try_divide(hits, p), "recall")


def _at_k(ranked, ks, keys, value, name):
    keys = keys or []
    sums = [F.count("*").alias("n"), F.sum("y").alias("p"), *(F.sum(F.when(F.col("rank") <= k, F.col("y"))).alias(f"h{i}") for i, k in enumerate(ks))]
    one = ranked.groupBy(*keys).agg(*sums)
    rows = F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("k"), value(F.coalesce(F.col(f"h{i}"), F.lit(0)).cast("double"), k, F.col("n").cast("double"), F.col("p").cast("double")).alias(name)) for i, k in enumerate(ks)]))
    return one.select(*keys, rows.alias("r")).select(*keys, "r.*")


def average_precision(ranked: DataFrame, keys: list[str] | None = None) -> DataFrame:
    y = F.col("y").cast("double")
    return ranked.groupBy(*(keys or [])).agg((F.sum(F.col("tp").cast("double") / F.col("rank") * y) / F.sum(y)).alias("average_precision"))


def roc_auc(df: DataFrame, keys: list[str] | None = None, score: str = "s", label: str = "y") -> DataFrame:
    """Mann-Whitney AUC with mid-ranks; null where one class is missing.

    Rows combine by score before anything is ordered, so ties of any number are one row.
    """
    keys = keys or []
    by = df.groupBy(*keys, score).agg(F.sum(label).alias("p"), (F.count("*") - F.sum(label)).alias("q"))
    below = running(_numbered(by, keys, score), keys, "rank", _upto="q").withColumn("below", F.col("_upto") - F.col("q"))
    wins = F.sum(F.col("p").cast("double") * (F.col("below").cast("double") + F.col("q").cast("double") / 2))
    return below.groupBy(*keys).agg(F.try_divide(wins, F.sum("p").cast("double") * F.sum("q").cast("double")).alias("roc_auc"), F.sum("p").cast("long").alias("n_pos"), F.sum("q").cast("long").alias("n_neg"))


def auc_against(base: DataFrame, classes: DataFrame, key: str, score: str = "s") -> DataFrame:
    """key, roc_auc, n: each class of ``classes`` (key, score) against the same ``base`` (score).

    Scores are ordered once for all classes; a class is then one aggregate over its own scores, so neither
    the base is copied for each class nor a class gathered in one task.
    """
    own = classes.groupBy(key, score).agg(F.count("*").alias("p"))
    scores = base.groupBy(score).agg(F.count("*").alias("q")).unionByName(own.select(score, F.lit(0).cast("long").alias("q"))).groupBy(score).agg(F.sum("q").alias("q"))
    ordered = numbered(scores, score, name="rank")
    below = running(ordered, [], "rank", _upto="q").select(score, "q", (F.col("_upto") - F.col("q")).alias("below"))
    total = ordered.agg(F.sum("q").cast("double").alias("_n"))
    wins = F.sum(F.col("p").cast("double") * (F.col("below").cast("double") + F.col("q").cast("double") / 2))
    each = own.join(below, score).groupBy(key).agg(wins.alias("_w"), F.sum("p").alias("n"))
    return each.crossJoin(F.broadcast(total)).select(key, F.try_divide("_w", F.col("n") * F.col("_n")).alias("roc_auc"), "n")  # one row


def metric_bundle(df: DataFrame, ks: list[int], idx: str = "idx") -> DataFrame:
    """One row: n_typical, n_novel, novel_rate, roc_auc, average_precision, precision_at_k and recall_at_k as maps.

    The rank is made once; all that is counted on it is one aggregate. Each k below 1 is left out.
    """
    ks = sorted({k for k in ks if k > 0})
    hit = [F.sum(F.when(F.col("rank") <= k, F.col("y"))) for k in ks]
    n, p = F.count("*").cast("double"), F.sum("y").cast("double")
    y = F.col("y").cast("double")
    entry = lambda value: F.map_from_arrays(F.array(*[F.lit(k).cast("long") for k in ks]), F.array(*value)) if ks else F.create_map().cast("map<bigint,double>")
    one = pessimistic_rank(df, idx=idx).agg(
        (F.count("*") - F.sum("y")).alias("n_typical"), F.sum("y").cast("long").alias("n_novel"), F.avg("y").alias("novel_rate"),
        F.try_divide(F.sum(F.col("tp").cast("double") / F.col("rank") * y), p).alias("average_precision"),
        entry([F.coalesce(h, F.lit(0)) / F.least(F.lit(float(k)), n) for k, h in zip(ks, hit, strict=True)]).alias("precision_at_k"),
        entry([F.try_divide(F.coalesce(h, F.lit(0)).cast("double"), p) for h in hit]).alias("recall_at_k"),
    )
    return one.crossJoin(roc_auc(df).select("roc_auc"))  # a row each


def validated(df: DataFrame, score: str = "s", label: str = "y") -> DataFrame:
    """Fails at run time on labels other than 0 and 1 and on scores that aren't finite."""
    ok = F.col(label).isin(0, 1) & F.col(score).isNotNull() & ~F.isnan(score) & (F.abs(F.col(score)) < F.lit(float("inf")))
    return df.filter(F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit("labels must be 0 or 1 and scores finite"))))


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c)
