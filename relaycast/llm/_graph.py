"""Connected components of an edge table by contraction, wholly in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import stored


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node), for every node of ``edges`` (a, b).

    A round points every node at the smallest of itself and its neighbours, and contracts edges along the
    pointers; edges between successive pointers keep chains together. A star ends after one round, a path
    of n nodes after about log n. Minima combine before they are shuffled; a hub with very many edges is
    one side of a plain join, which adaptive execution splits. Each round's tables go to the shared folder.
    """
    e = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    maps: list[DataFrame] = []
    while e.take(1):
        ends = e.select(F.col("a").alias("node"), F.col("b").alias("near")).unionByName(e.select(F.col("b").alias("node"), F.col("a").alias("near")))
        m = stored(ends.groupBy("node").agg(F.min("near").alias("near")).select("node", F.least("node", "near").alias("to")), "pointers")
        maps.append(m)
        to_a, to_b = m.select(F.col("node").alias("a"), F.col("to").alias("ta")), m.select(F.col("node").alias("b"), F.col("to").alias("tb"))
        contracted = e.join(to_a, "a").join(to_b, "b").select(F.col("ta").alias("a"), F.col("tb").alias("b"))
        chains = m.select(F.col("to").alias("b")).distinct().join(to_b, "b").select(F.col("b").alias("a"), F.col("tb").alias("b"))
        both = contracted.unionByName(chains).filter("a <> b")
        e = stored(both.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    if not maps:
        return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    found = maps[0].withColumnRenamed("to", "component")
    for m in maps[1:]:
        found = found.join(m.select(F.col("node").alias("component"), "to"), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return found
