"""The streamed mission against a plain loop: restarts, late frames, age, capacity, the last window."""

from __future__ import annotations

import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from relaycast.streaming import replay as S

SCHEMA = "run string, sol long, idx long, natural boolean, bits double, score double"
END = (None, 10_000, None, None, None, None)
WINDOW = ["run", "window", "first_sol", "last_sol", "n_arrived", "n_buffered", "n_selected", "n_expired", "n_evicted", "bits_used", "sent_natural", "n_late"]


def frames(seed, n=90, runs="ab", days=30):
    rng = random.Random(seed)
    return [(rng.choice(runs), rng.randrange(days), i, rng.random() < 0.4, float(rng.randint(1, 9)), float(rng.randint(0, 5))) for i in range(n)]


def looped(parts, length, max_age, budget, capacity=None):
    """Windows and late frames when ``parts`` come one after another and the watermark is the latest day so far."""
    windows, late, state, mark = [], [], {}, -math.inf
    for part in [*parts, [END]]:
        for f in part:
            if f[0] is None:
                continue
            s = state.setdefault(f[0], {"window": 0, "open": -math.inf, "waiting": [], "carried": [], "late": 0})
            if f[1] < s["open"]:
                late.append((f[0], f[1], f[2], s["window"]))
                s["late"] += 1
            else:
                s["waiting"].append(f)
        mark = max([mark, *(f[1] for f in part)])
        for run, s in state.items():
            while s["waiting"] and (first := min(f[1] for f in s["waiting"])) + length <= mark:
                new = [f for f in s["waiting"] if f[1] < first + length]
                s["waiting"] = [f for f in s["waiting"] if f[1] >= first + length]
                now = max(f[1] for f in new)
                fresh = sorted((f for f in s["carried"] + new if now - f[1] <= max_age), key=lambda f: (f[1], f[2]))
                over = max(0, len(fresh) - capacity) if capacity is not None else 0
                kept, used, sent = fresh[over:], 0.0, []
                for f in sorted(kept, key=lambda f: (-f[5], f[2])):
                    if used + f[4] <= budget:
                        used += f[4]
                        sent.append(f)
                windows.append((run, s["window"], first, now, len(new), len(kept), len(sent), len(s["carried"]) + len(new) - len(fresh), over, used, sum(f[3] for f in sent), s["late"]))
                s |= {"carried": [f for f in kept if f not in sent], "window": s["window"] + 1, "open": first + length, "late": 0}
    return sorted(windows), sorted(late)


def streamed(spark, parts, *rule, **more):
    made = [spark.createDataFrame(p, SCHEMA) for p in [*parts, [END]]]
    rows = S.played(spark, made, lambda s: S.replay_stream(s, *rule, 10_000, **more), "test")
    return sorted(map(tuple, rows.filter("kind = 'window'").select(WINDOW).collect())), sorted(map(tuple, rows.filter("kind = 'late'").select("run", "first_sol", "idx", "window").collect()))


def test_restarts_change_nothing(spark):
    """In order of days, one run of the query or four give the same rows; every frame is in a window, the last ones too."""
    rows = sorted(frames(1), key=lambda f: f[1])
    cuts = [0, *(next(i for i, f in enumerate(rows) if f[1] == d) for d in (7, 15, 22)), len(rows)]
    parts = [rows[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
    whole, none = streamed(spark, [rows], 4, 6, 12.0)
    assert none == [] and whole == looped([rows], 4, 6, 12.0)[0]
    assert streamed(spark, parts, 4, 6, 12.0) == (whole, [])
    assert sum(w[4] for w in whole) == len(rows)


def test_late_frames_are_returned_and_not_replayed(spark):
    rows = frames(2)
    parts = [rows[:30], rows[30:60], rows[60:]]  # in no order of days
    got, want = streamed(spark, parts, 5, 9, 15.0), looped(parts, 5, 9, 15.0)
    assert got == want and len(want[1]) > 5
    assert sum(w[4] for w in got[0]) + len(got[1]) == len(rows)
    # Of late frames that come after a run's last window, no window tells; their own rows do.
    assert sum(w[-1] for w in got[0]) <= len(got[1])


@pytest.mark.parametrize("capacity", [0, 3])
def test_capacity_evicts_the_oldest(spark, capacity):
    rows = sorted(frames(3), key=lambda f: f[1])
    got = streamed(spark, [rows], 4, 20, 8.0, capacity=capacity)
    assert got == looped([rows], 4, 20, 8.0, capacity) and sum(w[8] for w in got[0]) > 0


def test_a_delay_waits_for_frames_out_of_order(spark):
    rows = sorted(frames(4), key=lambda f: (f[1] // 6, f[2]))  # out of order inside six days
    parts = [rows[:40], rows[40:]]
    got, late = streamed(spark, parts, 4, 6, 12.0, delay="6 days")
    assert late == [] and got == looped([rows], 4, 6, 12.0)[0]


def test_nothing(spark):
    assert streamed(spark, [], 4, 6, 1.0) == ([], [])


def test_last_window_of_counts_is_open_until_the_watermark_passes(spark):
    rows = spark.createDataFrame([(i * 3600, "a", 1.0) for i in range(50)], "s long, class string, value double").select(F.timestamp_seconds("s").alias("ts"), "class", "value")
    end = rows.limit(1).select((F.col("ts") + F.expr("interval 100 days")).alias("ts"), F.lit(None).cast("string").alias("class"), "value")
    counted = lambda s: S.windowed_counts(s, "ts", "1 day", "1 hour")
    assert sum(r.n for r in S.played(spark, [rows], counted, "open").collect()) == 48
    assert sum(r.n for r in S.played(spark, [rows, end], counted, "ended").collect()) == 50


def test_state_follows_days_and_costs_not_frames(spark, monkeypatch):
    """A day's frames beyond what its windows can send are a count; those of no cost, or under a capacity, are all kept."""
    rows = frames(5, n=2000, runs="a", days=8)
    some = pd.DataFrame(rows, columns=["run", *S.COLUMNS])[S.COLUMNS]
    kept = S.sendable(some, 20.0, 3)
    assert len(kept) <= sum(8 * 3 * (20 // b + 1) for b in range(1, 10)) < 2000
    assert len(S.sendable(some.assign(bits=0.0), 20.0, 3)) == 2000 and not len(S.sendable(some.assign(bits=math.nan), 20.0, 3))
    rows = sorted(rows, key=lambda f: f[1])
    monkeypatch.setattr(S, "GATHERED", 50)
    for capacity in (None, 300):
        got = streamed(spark, [rows[:900], rows[900:]], 2, 5, 20.0, capacity=capacity)
        assert got == looped([rows], 2, 5, 20.0, capacity)
