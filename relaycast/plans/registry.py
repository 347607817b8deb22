"""Named queries and, where SQL can say it, the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


#: The mission stream of the driver's events: a frame an event, days since 2024-01-01.
MISSION = """mission AS (
  SELECT event_id AS idx, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS sol, event_type AS class, user_id, value AS score,
    CASE WHEN event_type = 'purchase' THEN 'natural' WHEN event_type = 'error' THEN 'rover' WHEN event_type IN ('view', 'click') THEN 'typical' ELSE 'excluded' END AS grp,
    CAST(length(props) * 8 AS DOUBLE) AS bits FROM events)"""


def mission(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("idx"),
        F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("long").alias("sol"),
        e.alias("class"),
        "user_id",
        F.col("value").alias("score"),
        F.when(e == "purchase", "natural").when(e == "error", "rover").when(e.isin("view", "click"), "typical").otherwise("excluded").alias("grp"),
        (F.char_length("props") * 8).cast("double").alias("bits"),
    )


def longs(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


def digest_tree_sql(lines: str, name: str = "tree", run: int = 64, levels: int = 5) -> str:
    """CTEs ``name``_0 (leaves) to ``name``_root of the digest tree over ``lines`` (key, line); levels above the root pass it on."""
    out = [
        f"{name}_lines AS (SELECT key, line, row_number() OVER (PARTITION BY key ORDER BY line) - 1 AS place FROM {lines})",
        f"{name}_0 AS (SELECT key, place // {run} AS node, sha256(string_agg(line || chr(10), '' ORDER BY place)) AS digest, count(*) AS n_lines FROM {name}_lines GROUP BY key, place // {run})",
    ]
    for k in range(1, levels + 1):
        made = "CASE WHEN max(max(node)) OVER (PARTITION BY key) = 0 THEN any_value(digest) ELSE sha256(string_agg(digest || chr(10), '' ORDER BY node)) END"
        out.append(f"{name}_{k if k < levels else 'root'} AS (SELECT key, node // {run} AS node, {made} AS digest, CAST(sum(n_lines) AS BIGINT) AS n_lines FROM {name}_{k - 1} GROUP BY key, node // {run})")
    return ", ".join(out)
