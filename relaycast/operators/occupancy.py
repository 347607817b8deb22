"""What is held at every point of an order of days: a sweep over arrivals and departures.

An item that arrives adds, one that leaves takes away; changes of one (group, day) are one row before anything is
ordered, so a group's rows are its days, however many items it has. Where one group's days are very many, ``ranges``
cuts them, and a range starts from the sums of those before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def changes(items: DataFrame, keys: list[str], arrive: str, leave: str, values: dict[str, str]) -> DataFrame:
    """keys, at, and for each value its change there; a null ``leave`` stays, an item that leaves when it comes is never held."""
    held = items.filter(F.col(arrive).isNotNull() & (F.col(leave).isNull() | (F.col(leave) > F.col(arrive))))
    both = held.select(*keys, F.explode(F.array(F.struct(F.col(arrive).alias("at"), F.lit(1).alias("_s")), F.struct(F.col(leave).alias("at"), F.lit(-1).alias("_s")))).alias("_x"), *[F.expr(v).alias(k) for k, v in values.items()])
    return both.filter("_x.at is not null").groupBy(*keys, F.col("_x.at").alias("at")).agg(*(F.sum(F.col(k) * F.col("_x._s")).alias(k) for k in values))


def occupancy(items: DataFrame, keys: list[str], arrive: str, leave: str, values: dict[str, str] | None = None, points: DataFrame | None = None, ranges: int = 1) -> DataFrame:
    """keys, at, and each of ``values`` (name: expression over items) summed over the items held then.

    An item is held from ``arrive`` on and no more at ``leave``. ``points`` (keys, at) are the places to tell; without
    them, every place where something changes. With ``ranges`` above 1, a group's places are cut into so many spans.
    """
    values = values or {"n_held": "1"}
    moved = changes(items, keys, arrive, leave, values)
    if points is not None:
        asked = points.select(*keys, "at").distinct().select(*keys, "at", *(F.lit(None).cast(moved.schema[k].dataType).alias(k) for k in values), F.lit(True).alias("_asked"))
        moved = moved.withColumn("_asked", F.lit(None).cast("boolean")).unionByName(asked).groupBy(*keys, "at").agg(*(F.sum(k).alias(k) for k in values), F.max("_asked").alias("_asked"))
    if ranges > 1:
        low, high = moved.agg(F.min("at"), F.max("at")).first()
        width = max(1, ((high or 0) - (low or 0)) // ranges + 1)
        moved = moved.withColumn("_range", F.floor((F.col("at") - F.lit(low or 0)) / width))
        sums = moved.groupBy(*keys, "_range").agg(*(F.sum(k).alias(f"_{k}") for k in values))
        before = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)  # at most ``ranges`` rows a group
        start = sums.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_range").alias("_r"), *(F.coalesce(F.sum(f"_{k}").over(before), F.lit(0)).alias(f"_{k}") for k in values))
        same = F.col("_range") == F.col("_r")
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        inside = W.partitionBy(*keys, "_range").orderBy("at")
        run = {k: F.coalesce(F.sum(k).over(inside), F.lit(0)) for k in values}
        swept = moved.withColumns({f"_in_{k}": v for k, v in run.items()}).join(start, same)
        swept = swept.select(*keys, "at", *(["_asked"] if points is not None else []), *((F.col(f"_in_{k}") + F.col(f"_{k}")).alias(k) for k in values))
    else:
        own = W.partitionBy(*keys).orderBy("at")
        swept = moved.withColumns({k: F.coalesce(F.sum(k).over(own), F.lit(0)) for k in values})
    return swept.filter("_asked").drop("_asked") if points is not None else swept
