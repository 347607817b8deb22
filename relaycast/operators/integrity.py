"""Checks on manifests: duplicates, collisions, overlaps, fingerprints; union and dedup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numbering import numbered

#: Splits that describe the same items and must not be read together.
FORBIDDEN = (frozenset({"test_novel_all", "test_novel_byclass"}),)


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def collisions(rows: DataFrame, name: str, group: str) -> DataFrame:
    """Names found in several groups; groups combine per name before they are counted."""
    return rows.select(name, group).filter(F.col(group).isNotNull()).distinct().groupBy(name).agg(F.count("*").alias("n_groups")).filter("n_groups > 1")


def overlaps(rows: DataFrame, name: str, group: str) -> DataFrame:
    """Shared names of each pair of groups; pairs come from a name's set of groups, not from its rows."""
    sets = rows.select(name, group).distinct().groupBy(name).agg(F.array_sort(F.collect_list(group)).alias("g")).filter(F.size("g") > 1)
    first = sets.select("g", F.posexplode("g").alias("i", "left_split"))
    return first.select("left_split", F.explode(F.slice("g", F.col("i") + 2, F.size("g"))).alias("right_split")).groupBy("left_split", "right_split").agg(F.count("*").alias("n_shared"))


def assert_no_double_count(rows: DataFrame, name: str, group: str) -> None:
    found = collisions(rows, name, group).limit(5).collect()
    if found:
        raise ValueError(f"items counted twice, in several groups: {[r[0] for r in found]}")


def assert_splits_combinable(splits: list[str]) -> None:
    for pair in FORBIDDEN:
        if pair <= set(splits):
            raise ValueError(f"{sorted(pair)} hold the same items")


def keep_first(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of least ``order`` of each key; minima combine before the shuffle."""
    rest = [c for c in rows.columns if c not in keys and c != order]
    return rows.groupBy(*keys).agg(F.min(F.struct(order, *rest)).alias("_m")).select(*keys, "_m.*")


def concatenate(rows: DataFrame, split: str, order: str) -> DataFrame:
    """idx over all splits in order: one numbering of the whole table, splits of any size."""
    return numbered(rows, split, order, name="idx")


def leaks(path: Column, name: str) -> Column:
    """Whether a parent directory has this name."""
    parts = F.split(path, "/")
    return F.array_contains(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), name)


def missing(*columns: str) -> Column:
    return F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in columns]))
