"""Digests of ordered lines as a tree: leaves over runs of a fixed length, parents over runs of their children.

Lines are numbered over the whole table by ranges, so no class is gathered; a node holds at most ``run`` lines or
digests. A node that is alone on its level is the root. Two trees are compared from their roots down, reading only
beneath nodes that differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .numbering import numbered_within

RUN = 64
_TEXT = "_text"


def _joined(place: str, text: Column | str) -> Column:
    """Aggregate: sha256 of at most a run of texts in order, each with its newline."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct(place, text))), lambda x: F.concat(x[_TEXT], F.lit("\n")))
    return F.sha2(F.array_join(parts, ""), 256)


def tree(rows: DataFrame, key: str, line: Column, run: int = RUN) -> DataFrame:
    """key, level, node, digest, n_lines: level 0 holds the leaves; lines are in their own ascending order."""
    if run < 2:
        raise ValueError("a run holds two lines at least")
    lines = rows.select(F.col(key).alias("key"), F.coalesce(line, F.lit("")).alias(_TEXT))
    placed = numbered_within(lines, ["key"], _TEXT)
    node = F.floor(F.col("place") / run).cast("long")
    level = stored(placed.groupBy("key", node.alias("node")).agg(_joined("place", _TEXT).alias("digest"), F.count("*").alias("n_lines")).withColumn("level", F.lit(0)), "leaves")
    levels = [level]
    while level.filter("node > 0").take(1):
        grouped = level.select("key", F.col("node").alias("place"), F.col("digest").alias(_TEXT), "n_lines").groupBy("key", F.floor(F.col("place") / run).cast("long").alias("node"))
        made = grouped.agg(F.count("*").alias("_n"), F.first(_TEXT).alias("_own"), _joined("place", _TEXT).alias("_digest"), F.sum("n_lines").alias("n_lines"))
        # A class that had its root already passes it on, unhashed.
        alone = level.groupBy(F.col("key").alias("_key")).agg((F.max("node") == 0).alias("_root"))
        up = made.join(alone, F.col("key").eqNullSafe(F.col("_key")))
        level = stored(up.select("key", "node", F.when(F.col("_root"), F.col("_own")).otherwise(F.col("_digest")).alias("digest"), "n_lines", F.lit(len(levels)).alias("level")), "parents")
        levels.append(level)
    out = levels[0]
    for more in levels[1:]:
        out = out.unionByName(more)
    return out.select("key", "level", "node", "digest", "n_lines")


def roots(made: DataFrame) -> DataFrame:
    """key, digest, n_lines of each class."""
    top = made.filter("node = 0").groupBy("key").agg(F.max_by(F.struct("digest", "n_lines"), "level").alias("x"))
    return top.select("key", "x.digest", "x.n_lines")


def changed(old: DataFrame, new: DataFrame, run: int = RUN) -> DataFrame:
    """key, node: leaves that differ between two stored trees (or that one of them lacks), found from the roots down."""
    height = max(t.agg(F.max("level")).first()[0] or 0 for t in (old, new))  # a row each

    def differing(level: int) -> DataFrame:
        a, b = (t.filter(F.col("level") == level).select("key", "node", "digest") for t in (old, new))
        both = a.alias("a").join(b.alias("b"), F.col("a.key").eqNullSafe(F.col("b.key")) & (F.col("a.node") == F.col("b.node")), "full")
        return both.filter("not (a.digest <=> b.digest)").select(F.coalesce("a.key", "b.key").alias("key"), F.coalesce("a.node", "b.node").alias("node"))

    found = None
    for level in range(height, -1, -1):
        own = differing(level)
        if found is not None:
            above = found.select(F.col("key").alias("_k"), F.col("node").alias("_n"))
            own = own.join(above, F.col("key").eqNullSafe(F.col("_k")) & (F.floor(F.col("node") / run) == F.col("_n")), "left_semi")
        found = stored(own, "changed")
    return found
