"""The mission as a stream: keyed state with event-time timers, carry-over, and windowed counts with a watermark.

A run's frames arrive in any order within the watermark's delay. What arrives is appended to the run's list of
days that no window holds yet, a day's frames as arrays in one element; nothing else is rewritten by a batch. A timer
stands at the end of the earliest window that can be closed, and closes it once the watermark has passed: frames past
their age expire, the oldest beyond the capacity are evicted, a walk by score under the bit budget sends, and what is
left carries over. Only then is the carried list written anew. Frames of a window that is closed are late; they are
returned as such, each in a row of its own, and not replayed. (A time to live isn't used for the age: Spark bounds it to
processing time.)

Frames of one day and equal bits are sent in order of their scores, no more than fit the budget in each of the few
windows that hold the day. The ones beyond are never sent, so of them the state has only a count a day; so it follows
days and costs, not frames. (With a capacity all frames are kept, as any may be what an eviction reaches.)

State, checkpoint and output are in the shared folder: a query that stops goes on from its checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.selection import walk
from ..session import shared_path, with_workers

#: A day's frames: how many there are, and those that are kept as arrays (idx, natural, bits, score), one behind the other.
DAY = "sol long, n long, kept binary"
COLUMNS = ["sol", "idx", "natural", "bits", "score"]
_KINDS = {"idx": np.int64, "natural": np.int8, "bits": np.float64, "score": np.float64}
#: Frames of a batch that are gathered before they are cut to what can be sent.
GATHERED = 1 << 18
#: window rows have idx null; late rows have their frame's sol (as first_sol) and idx, and the window that was next.
OUT = (
    "kind string, run string, window long, first_sol long, last_sol long, n_arrived long, n_buffered long, n_selected long, n_expired long, n_evicted long, "
    "bits_used double, sent_natural long, n_late long, idx long"
)
NAMES = [c.split(" ")[0] for c in OUT.split(", ")]
DAY_MS = 86_400_000


def close(held: pd.DataFrame, now: int, max_age: int, budget: float, capacity: int | None = None, counts: dict[int, int] | None = None) -> tuple[dict, pd.DataFrame, dict[int, int]]:
    """What a closing window expires, evicts and sends (``held`` has carried and new frames), and what carries over.

    ``counts`` has all frames of each day, also those that ``held`` leaves out as they are never sent.
    """
    counts = held["sol"].value_counts().to_dict() if counts is None else counts
    counted = {sol: n for sol, n in counts.items() if now - sol <= max_age}
    fresh = held[now - held["sol"] <= max_age].sort_values(["sol", "idx"], kind="stable")
    over = 0 if capacity is None else max(0, len(fresh) - capacity)
    kept, n = fresh.iloc[over:], sum(counted.values())
    order = np.lexsort((kept["idx"].to_numpy(), -kept["score"].to_numpy(float)))
    taken = walk(order, kept["bits"].to_numpy(float), np.zeros(len(kept)), budget, 1.0)
    left = np.ones(len(kept), bool)
    left[taken] = False
    sent = kept.iloc[taken]
    out = {"n_buffered": n - over, "n_selected": len(taken), "n_expired": sum(counts.values()) - n, "n_evicted": over, "bits_used": float(sent["bits"].sum()), "sent_natural": int(sent["natural"].sum())}
    for gone in (fresh.iloc[:over], sent):
        for sol, m in gone["sol"].value_counts().items():
            counted[sol] -= m
    return out, kept[left], {sol: m for sol, m in counted.items() if m}


def sendable(frames: pd.DataFrame, budget: float, turns: int) -> pd.DataFrame:
    """Frames that walks of ``turns`` windows can send: of each day and cost (not negative), the best that fit each budget and one for rounding."""
    sol, bits = frames["sol"].to_numpy(), frames["bits"].to_numpy(float)
    order = np.lexsort((frames["idx"].to_numpy(), -frames["score"].to_numpy(float), bits, sol))
    sol, bits = sol[order], bits[order]
    begins = np.ones(len(order), bool)
    begins[1:] = (sol[1:] != sol[:-1]) | (bits[1:] != bits[:-1])
    at = np.flatnonzero(begins)
    rank = np.arange(len(order)) - np.repeat(at, np.diff(at, append=len(order)))
    with np.errstate(divide="ignore", invalid="ignore"):
        most = np.where(bits > 0, turns * (np.floor(budget / bits) + 1), np.where(np.isnan(bits), 0, np.inf))
    return frames.iloc[order[rank < most]]


class Replay(StatefulProcessor):
    """One run's windows; see the module."""

    def __init__(self, length: int, max_age: int, budget: float, capacity: int | None):
        self.length, self.max_age, self.budget, self.capacity = length, max_age, budget, capacity

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", DAY)
        self.carried = handle.getListState("carried", DAY)
        #: next window, first day that isn't in a closed one, earliest waiting day, late frames since the last window
        self.marks = handle.getValueState("marks", "window long, open_from long, first long, late long")

    def _end(self, first: int) -> int:
        """The timer of a window that begins then: just before its last moment, as timers fire when passed."""
        return (first + self.length) * DAY_MS - 1

    def _sendable(self, frames: pd.DataFrame) -> pd.DataFrame:
        # A day is held by the window that it arrives in, and by those that begin until its age is over.
        return frames if self.capacity is not None else sendable(frames, self.budget, self.max_age // self.length + 2)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        window, open_from, first, late = self.marks.get() or (0, None, None, 0)
        earliest, counts, some = first, {}, []
        for batch in rows:
            old = batch["sol"] < open_from if open_from is not None else pd.Series(False, index=batch.index)
            if old.any():
                late += int(old.sum())
                yield pd.DataFrame({"kind": "late", "run": key[0], "window": window, "first_sol": batch["sol"][old], "idx": batch["idx"][old]}).reindex(columns=NAMES)
            own = batch[~old]
            if len(own):
                earliest = int(own["sol"].min()) if earliest is None else min(earliest, int(own["sol"].min()))
                for sol, n in own["sol"].value_counts().items():
                    counts[sol] = counts.get(sol, 0) + n
                some.append(own[COLUMNS].assign(natural=own["natural"].eq(True)))
                if sum(map(len, some)) >= GATHERED:
                    some = [self._sendable(pd.concat(some))]
                    if len(some[0]) > GATHERED // 2:
                        self.waiting.appendList(_packed(some[0], counts))
                        counts, some = {}, []
        if counts:
            self.waiting.appendList(_packed(self._sendable(pd.concat(some)), counts))
        if earliest != first:
            if first is not None:
                self.handle.deleteTimer(self._end(first))
            self.handle.registerTimer(self._end(earliest))
        self.marks.update((window, open_from, earliest, late))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        window, open_from, first, late = self.marks.get()
        waiting, held = _read(self.waiting), _read(self.carried) if self.carried.exists() else []
        (carried, carried_n), rows = _joined(held), []
        waiting.sort(key=lambda day: day[0])
        while waiting and self._end(first := waiting[0][0]) < passed:
            cut = next((k for k, day in enumerate(waiting) if day[0] >= first + self.length), len(waiting))
            (new, new_n), waiting = _joined(waiting[:cut]), waiting[cut:]
            last = max(new_n)
            counts = {sol: carried_n.get(sol, 0) + new_n.get(sol, 0) for sol in {**carried_n, **new_n}}
            done, carried, carried_n = close(pd.concat([carried, new]) if len(carried) else new, last, self.max_age, self.budget, self.capacity, counts)
            rows.append({"kind": "window", "run": key[0], "window": window, "first_sol": first, "last_sol": last, "n_arrived": sum(new_n.values()), **done, "n_late": late})
            window, open_from, late = window + 1, first + self.length, 0
        first = waiting[0][0] if waiting else None
        for state, left in ((self.waiting, waiting), (self.carried, _packed(carried, carried_n))):
            if left:
                state.put(left)
            else:
                state.clear()
        if first is not None:
            self.handle.registerTimer(self._end(first))
        self.marks.update((window, open_from, first, late))
        if rows:
            yield pd.DataFrame(rows).reindex(columns=NAMES)

    def close(self) -> None:
        pass


def _packed(frames: pd.DataFrame, counts: dict[int, int]) -> list[tuple]:
    """Each day of ``counts`` as an element of the state, with its frames."""
    own = {sol: f for sol, f in frames.groupby("sol", sort=False)}
    return [(int(sol), int(n), b"".join(own[sol][c].astype(k).to_numpy().tobytes() for c, k in _KINDS.items()) if sol in own else b"") for sol, n in sorted(counts.items())]


def _read(state: Any) -> list[tuple]:
    return [(int(sol), int(n), bytes(kept)) for sol, n, kept in state.get()]


def _joined(days: list[tuple]) -> tuple[pd.DataFrame, dict[int, int]]:
    """The frames of some elements, and how many frames each day has."""
    counts: dict[int, int] = {}
    parts: dict[str, list] = {c: [] for c in COLUMNS}
    for sol, n, kept in days:
        counts[sol] = counts.get(sol, 0) + n
        m, at = len(kept) // sum(np.dtype(k).itemsize for k in _KINDS.values()), 0
        parts["sol"].append(np.full(m, sol, np.int64))
        for c, k in _KINDS.items():
            parts[c].append(np.frombuffer(kept, k, m, at))
            at += m * np.dtype(k).itemsize
    found = {c: np.concatenate(x) if x else np.zeros(0, _KINDS.get(c, np.int64)) for c, x in parts.items()}
    return pd.DataFrame(found | {"natural": found["natural"].astype(bool)}), counts


def at_day(sol) -> F.Column:
    return F.timestamp_millis(sol.cast("long") * DAY_MS)


def replay_stream(events: DataFrame, length: int, max_age: int, budget: float, flush_sol: int, capacity: int | None = None, delay: str = "0 days") -> DataFrame:
    """Windows and late frames of each run of (run, sol, idx, natural, bits, score).

    The watermark follows ``delay`` behind the latest day over all runs. An event at ``flush_sol``, of any run, ends
    the stream: it is in no window, and lets the last ones close.
    """
    with_workers(events.sparkSession)
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    timed = events.withColumn("_at", at_day(F.col("sol"))).withWatermark("_at", delay)
    # Without the time column no frame is dropped before its run has judged it.
    own = timed.filter(F.col("_at") < at_day(F.lit(flush_sol))).select("run", *COLUMNS)
    return own.groupBy("run").transformWithStateInPandas(Replay(length, max_age, budget, capacity), OUT, "append", "eventTime")


def windowed_counts(events: DataFrame, at: str, every: str, late: str) -> DataFrame:
    """Counts by tumbling event-time window and class; rows later than the watermark are dropped."""
    return events.withWatermark(at, late).groupBy(F.window(at, every).alias("w"), "class").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), "class", "n", "value")


def run_on(stream: DataFrame, path: str) -> None:
    """Runs a query over what is there now, from its checkpoint on; rows are appended below ``path``."""
    q = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()


def played(spark: SparkSession, parts: list[DataFrame], make: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """All rows of ``make(stream)`` for a stream that gets ``parts`` one after another.

    Each part lands in a folder and is one run of the query, which then stops; the next goes on from the checkpoint.
    """
    path = shared_path(spark, name)
    for part in parts:
        part.write.mode("append").parquet(f"{path}/landed")
        stream = spark.readStream.schema(parts[0].schema).parquet(f"{path}/landed")
        run_on(make(stream), path)
    return spark.read.parquet(f"{path}/rows")
