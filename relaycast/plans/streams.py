"""Streaming forms of the mission queries: a table lands in order of days, part by part, and a last row ends the stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import table
from ..streaming import replay as S
from .registry import query

#: Past every day: an event there ends the stream.
FLUSH = 10_000
#: Parts in which a table lands.
PARTS = 3


def _parts(rows, at, end):
    """``rows`` by the numeric column ``at`` in ranges of equal width, then the row that ends the stream."""
    low, high = rows.agg(F.min(at), F.max(at)).first()
    if low is None:
        return [end]
    width = (high - low) // PARTS + 1
    return [*(rows.filter((F.col(at) >= low + k * width) & (F.col(at) < low + (k + 1) * width)) for k in range(PARTS)), end]


@query()
def stream_replay(spark, sf_dir):
    e = F.col("event_type")
    frames = table(spark, sf_dir, "events").select(
        (F.col("user_id") % 4).cast("string").alias("run"),
        F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("long").alias("sol"),
        F.col("event_id").alias("idx"),
        (e == "purchase").alias("natural"),
        (F.char_length("props") * 8).cast("double").alias("bits"),
        F.col("value").alias("score"),
    )
    end = spark.createDataFrame([(None, FLUSH, None, None, None, None)], frames.schema)
    got = S.played(spark, _parts(frames, "sol", end), lambda s: S.replay_stream(s, 4, 10, 6000.0, FLUSH), "replay")
    return got.filter("kind = 'window'").select("run", "window", "first_sol", "last_sol", "n_arrived", "n_buffered", "n_selected", "n_expired", "bits_used", "sent_natural", "n_late")


@query("""SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type AS class, count(*) AS n, round(sum(value), 4) AS value FROM events WHERE ts IS NOT NULL GROUP BY 1, 2""")
def stream_windowed_counts(spark, sf_dir):
    """Every day's counts, the last day's too: the row that ends the stream is 1000 days later, in a window that stays open."""
    events = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("class"), "value").withColumn("s", F.unix_seconds("ts"))
    end = events.agg((F.max("ts") + F.expr("interval 1000 days")).alias("ts"), F.lit(None).cast("string").alias("class"), F.lit(None).cast("double").alias("value"), F.lit(None).cast("long").alias("s"))
    got = S.played(spark, _parts(events, "s", end), lambda s: S.windowed_counts(s, "ts", "1 day", "1 hour"), "counts")
    return got.select(F.col("start").cast("timestamp_ntz").alias("start"), "class", "n", F.round("value", 4).alias("value"))
