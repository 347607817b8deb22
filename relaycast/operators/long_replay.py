"""Replays of missions of any length: a mission is chunks of frames in order, and no task holds more than a chunk.

What becomes of a frame under a run depends on its own row and on a few cuts that the run makes in each window: how far
it evicts, how far it scores in order of the prefilter, and how far its walk sends in order of value. So nothing of a
frame is kept between windows: a task works its chunk's frames out again from the cuts so far (of the windows in which
they are held). A cut is found by digests: each chunk gives some of its keys in order with counts and bits up to them,
which bounds the cut between two keys, and again between those, until it is exact. All runs of all missions ask in the
same jobs; the driver holds cuts, digests and one pool of a refit (``refit_max`` frames).

Sums of bits are exact where bits are whole numbers (below 2^53). Means and deviations of statistics are summed by
chunk, so they may differ from ``replay.replay``'s in the last bits.
"""

from __future__ import annotations

import pickle
from collections.abc import Generator
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored, with_workers
from .replay import SCORE_BASED, Config, Rows, Running, chain

#: Frames, and bytes of frames, of a chunk at most; digest keys of a job in all.
CHUNK, CHUNK_BYTES, KEYS = 1 << 17, 8 << 20, 200_000
_GROUPS = {"natural": 0, "rover": 1, "typical": 2}
_BLOBS = ("idx", "sol", "grp", "bits", "stats", "score", "features")
#: A cut that takes nothing, and one that takes all.
NONE, ALL = (-np.inf, -(1 << 62)), (np.inf, 1 << 62)


# ---- chunks


def packed(frames: DataFrame, by: list[str], n: int, width: int) -> DataFrame:
    """The missions in order as chunks, a row each: by, part and seq (their order), n, days with sums, and arrays as bytes."""
    rows = max(1, min(CHUNK, CHUNK_BYTES // (8 * (5 + width))))
    wide = "features" in frames.columns
    columns = [c for c in _BLOBS if c != "features" or wide]
    order = [*by, F.col("sol") < 0, "sol", "idx"]
    grp = F.coalesce(*[F.when(F.col("grp") == g, k) for g, k in _GROUPS.items()], F.lit(3)).cast("byte")
    own = frames.withColumn("sol", F.coalesce(F.col("sol"), F.lit(-1)).cast("long")).withColumn("grp", grp).select(*by, *columns)
    ranged = own.repartitionByRange(max(1, -(-n // rows)), *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())

    def chunk(key: tuple, seq: int, t: pa.Table) -> pa.RecordBatch:
        a = {c: np.ascontiguousarray(t.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False) if c in ("stats", "features") else t.column(c).to_numpy()) for c in columns}
        days, at = np.unique(a["sol"], return_inverse=True)
        sums = {"d_sol": days, "d_n": np.bincount(at), "d_bits": np.bincount(at, a["bits"]), "d_natural": np.bincount(at, a["grp"] == 0)}
        blobs = [pa.array([np.asarray(x, x.dtype if c == "grp" else np.int64 if c in ("idx", "sol", "d_sol", "d_n") else float).tobytes()], pa.binary()) for c, x in (sums | a).items()]
        extra = [pa.array([float(a["bits"].min())]), pa.array([int(a["sol"].max())], pa.int64()), pa.array([len(a["idx"])], pa.int64())]
        keys = [t.column(c).slice(0, 1).combine_chunks() for c in by]
        return pa.RecordBatch.from_arrays([*keys, pa.array([key[-1]], pa.int32()), pa.array([seq], pa.int32()), *extra, *blobs], names=[*by, "part", "seq", "least", "last", "n", *sums, *a])

    def run(batches):
        held, size, seq, key = [], 0, 0, None
        for batch in batches:
            names = list(zip(*(batch.column(c).to_pylist() for c in [*by, "_part"]), strict=True)) if by else [(batch.column("_part")[0].as_py(),)] * min(1, batch.num_rows)
            at = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1])] if batch.num_rows else []
            for a, b in zip(at, [*at[1:], batch.num_rows], strict=True):
                if held and (names[a] != key or size >= rows):
                    yield chunk(key, seq, pa.Table.from_batches(held))
                    held, size, seq = [], 0, seq + 1
                key = names[a]
                held.append(batch.slice(a, b - a))
                size += b - a
        if held:
            yield chunk(key, seq, pa.Table.from_batches(held))

    keyed = "".join(f"`{c}` {frames.schema[c].dataType.simpleString()}, " for c in by)
    sums = "d_sol binary, d_n binary, d_bits binary, d_natural binary"
    return stored(ranged.mapInArrow(run, f"{keyed}part int, seq int, least double, last long, n long, {sums}, " + ", ".join(f"{c} binary" for c in columns)), "chunks")


@dataclass
class Arriving:
    first: int
    now: int
    n: int
    natural: int


@dataclass
class Mission:
    """What the driver knows of a mission: its chunks (part, seq, start, n, last day), its windows' arrivals, its sums."""

    key: tuple
    chunks: list[tuple]
    plan: list[Arriving]
    n: int
    bits: float
    natural: int
    least: float
    starts: np.ndarray

    @classmethod
    def of(cls, key: tuple, rows: list, length: int) -> Mission:
        rows = sorted(rows, key=lambda r: (r.part, r.seq))
        at = np.cumsum([0, *(r.n for r in rows)]).tolist()
        every = [np.frombuffer(b"".join(r[c] for r in rows), t) for c, t in (("d_sol", np.int64), ("d_n", np.int64), ("d_bits", float), ("d_natural", float))]
        days, own = np.unique(every[0], return_inverse=True)
        n, bits, natural = (np.bincount(own, x) for x in every[1:])
        plan, starts, k = [], [], int(np.searchsorted(days, 0))
        undated = slice(0, k)
        while k < len(days):
            to = int(np.searchsorted(days, days[k] + length, "left"))
            plan.append(Arriving(int(days[k]), int(days[to - 1]), int(n[k:to].sum()), int(natural[k:to].sum())))
            starts.append(days[k])
            k = to
        if undated.stop:
            plan.append(Arriving(-1, int(days[undated].max()), int(n[undated].sum()), int(natural[undated].sum())))
        return cls(key, [(r.part, r.seq, a, r.n, r.last) for r, a in zip(rows, at[:-1], strict=True)], plan, at[-1], float(bits.sum()), int(natural.sum()), min(r.least for r in rows), np.array(starts, np.int64))

    def alive(self, w: int, max_age: int) -> list[int]:
        """Chunks with frames that window ``w`` may hold or lose."""
        before, ends = self.plan[w - 1].now if w else -1, np.cumsum([a.n for a in self.plan])
        first, last = (np.searchsorted(ends, [start + (n - 1) * k for _, _, start, n, _ in self.chunks], "right") for k in (0, 1))
        return [k for k, c in enumerate(self.chunks) if first[k] <= w and (last[k] >= w or before - c[4] <= max_age)]


@dataclass
class Chunk:
    """A chunk in a task: its frames' arrays, their place in the order of candidates and their window."""

    no: int
    idx: np.ndarray
    sol: np.ndarray
    grp: np.ndarray
    bits: np.ndarray
    stats: np.ndarray
    score: np.ndarray
    features: np.ndarray | None
    place: np.ndarray
    win: np.ndarray
    memo: dict = field(default_factory=dict)


# ---- runs


@dataclass
class Passed:
    """A window of a run: what it was given, and the cuts that it made."""

    now: int
    running: Running
    reset: bool = False
    skip: bool = False
    evict: int | None = None
    model: Any = None
    scored: tuple = NONE
    allowance: float = 1.0
    bump: float = 0.0
    sent: tuple = NONE
    extra: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    #: of the random policy: numbers drawn before each chunk's undated and dated candidates
    drawn: dict[int, tuple[int, int]] = field(default_factory=dict)


@dataclass
class Course:
    method: str
    cfg: Config
    bits_budget: float
    past: list[Passed] = field(default_factory=list)


@dataclass
class Ask:
    """What a run wants of its chunks: the sums of window ``w`` (with those of ``w - 1``'s end), keys, or pool rows."""

    w: int
    stage: str
    result: bool = False
    order: str | None = None
    lo: tuple = NONE
    hi: tuple = ALL
    most_bits: float = np.inf
    head: int | None = None
    pool: int | None = None
    chunks: list[int] | None = None


def _before(key: np.ndarray, tie: np.ndarray, cut: tuple) -> np.ndarray:
    return (key < cut[0]) | (key == cut[0]) & (tie < cut[1])


def _z(c: Chunk, r: Course, w: int) -> np.ndarray:
    out = np.zeros(len(c.idx))
    for j in range(int(c.win[0]), min(w, int(c.win[-1])) + 1):
        own, run = slice(*np.searchsorted(c.win, [j, j + 1])), r.past[j].running
        if own.start < own.stop:
            key = ("z", j, run.n, run.mean.tobytes(), run.m2.tobytes())
            if key not in c.memo:
                c.memo[key] = run.z(c.stats[own])
            out[own] = c.memo[key]
    return out


def _value(c: Chunk, r: Course, p: Passed, fit) -> np.ndarray:
    if p.model is None:
        return c.score
    if ("m", id(p.model)) not in c.memo:
        c.memo["m", id(p.model)] = fit.apply(p.model, c)
    return c.memo["m", id(p.model)]


def _order(c: Chunk, r: Course, p: Passed, value: np.ndarray, eligible: np.ndarray) -> np.ndarray:
    """Keys of the walk: least first."""
    if r.method == "fifo":
        return c.sol * 10_000.0 + c.idx
    if r.method == "random":
        key = np.zeros(len(c.idx))
        for own, at in zip((eligible & (c.sol < 0), eligible & (c.sol >= 0)), p.drawn.get(c.no, (0, 0)), strict=True):
            bits = np.random.PCG64(r.cfg.seed)
            bits.advance(at)
            key[own] = -np.random.Generator(bits).random(int(own.sum()))
        return key
    if r.method == "score_first":
        return -value
    cost = 0.5 * (c.bits / r.bits_budget) + 0.5 * (r.cfg.compress_cycles / p.allowance)
    return -np.divide(value + p.bump, cost, out=np.full(len(value), np.inf), where=cost > 0)


def fate(c: Chunk, r: Course, ask: Ask, fit, listed: dict | None = None) -> dict:
    """A chunk's frames under a run up to a stage of ``ask.w`` (``kept``: expired and evicted; ``scored``; ``sent``)."""
    n, cfg, needs = len(c.idx), r.cfg, r.method in SCORE_BASED
    held, scored, ever_held, ever_scored, fed = (np.zeros(n, bool) for _ in range(5))
    natural, out, z = c.grp == 0, {}, None
    for j in range(int(c.win[0]), ask.w + 1):
        p = r.past[j]
        if int(c.win[-1]) < j < ask.w and not held.any():
            continue
        held |= c.win == j
        old = held & (np.maximum(p.now - c.sol, 0) > cfg.max_age)
        held &= ~old
        over = held & (c.place < p.evict) if p.evict is not None else np.zeros(n, bool)
        held &= ~over
        if p.reset:
            scored[:] = False
        if j == ask.w and ask.stage == "kept":
            new = held & (c.win == j)
            moved = Running()
            if new.any():
                moved.add(c.stats[new])
            out["kept"] = {"old": int(old.sum()), "old_natural": int((old & natural).sum()), "over_natural": int((over & natural).sum()), "held": int(held.sum()), "held_undated": int((held & (c.sol < 0)).sum()), "moved": moved, "waiting": int((held & ~scored).sum())}
            break
        if listed is not None and (old.any() or over.any()):
            listed.setdefault(j, {}).update(old=c.idx[old], over=c.idx[over][np.argsort(c.place[over])], over_place=np.sort(c.place[over]))
        if p.skip:
            continue
        value, news, first_held = c.score, np.zeros(n, bool), np.zeros(n, bool)
        eligible = held
        if needs:
            first_held = held & ~ever_held
            ever_held |= held
            z = _z(c, r, ask.w) if z is None else z
            take = held & ~scored & _before(-z, c.idx, p.scored)
            value = _value(c, r, p, fit)
            news = take & ~ever_scored
            ever_scored |= take
            scored |= take & ~np.isnan(value)
            eligible = held & scored
        elif r.method == "oracle":
            value = natural.astype(float)
        if j == ask.w and ask.stage == "scored":
            break
        key = _order(c, r, p, value, eligible)
        sent = eligible & (_before(key, c.place, p.sent) | np.isin(c.place, p.extra))
        if listed is not None and sent.any():
            listed.setdefault(j, {}).update(sent=c.idx[sent], key=key[sent], sent_place=c.place[sent])
        if ask.result and j == ask.w - (ask.stage != "sent"):
            left = eligible & ~sent
            kinds = [sent & natural, sent & (c.grp == 1), sent & (c.grp > 1)]
            out["result"] = {
                "of": [int(k.sum()) for k in kinds], "bits_of": [float(c.bits[k].sum()) for k in kinds], "left": int(left.sum()), "left_most": float(c.bits[left].max()) if left.any() else -np.inf, "eligible": int(eligible.sum()),
                "held_natural": int((held & natural).sum()), "scored_natural": int((held & scored & natural).sum()),
                "first_held": int(first_held.sum()), "first_held_natural": int((first_held & natural).sum()), "news": int(news.sum()), "news_natural": int((news & natural).sum()),
            }
        held = held & ~sent
        scored = scored & ~sent
        if cfg.ground_feedback:
            fed |= sent & (c.grp != 2)
    if ask.pool is not None:
        at = np.flatnonzero((c.win <= ask.w) & ~fed)[-ask.pool :]
        out["pool"] = {"idx": c.idx[at], "stats": c.stats[at], "features": None if c.features is None else c.features[at]}
    if ask.order is not None:
        if ask.order == "place":
            scope, key, tie = held, np.zeros(n), c.place
        elif ask.order == "z":
            scope, key, tie = held & ~scored, -(_z(c, r, ask.w) if z is None else z), c.idx
        else:
            scope, key, tie = eligible, _order(c, r, p, value, eligible), c.place
            out["positive"] = bool((value[eligible] > 0).any())
        scope = scope & (c.bits <= ask.most_bits) if ask.head is not None else scope
        low = _before(key, tie, ask.lo) | (key == ask.lo[0]) & (tie == ask.lo[1])
        out["below"] = (int((scope & low).sum()), float(c.bits[scope & low].sum()))
        at = np.flatnonzero(scope & ~low & (_before(key, tie, ask.hi) | (key == ask.hi[0]) & (tie == ask.hi[1])))
        out["points"] = (key[at], tie[at], c.bits[at])
    return out


def _thin(points: tuple, most: int, head: int | None) -> tuple:
    """Keys in order, each with how many items and bits it stands for (the ones since the key before)."""
    key, tie, bits = points
    order = np.lexsort((tie, key))
    if head is not None:
        cut = len(order) > head
        order = order[:head]
        return key[order], tie[order], np.ones(len(order), np.int64), bits[order], cut
    ends = np.arange(len(order)) if len(order) <= most else np.unique(np.linspace(0, len(order) - 1, most + 1).astype(np.int64)[1:])
    count = np.diff(ends, prepend=-1)
    total = np.cumsum(bits[order])[ends] if len(order) else np.zeros(0)
    return key[order][ends], tie[order][ends], count, np.diff(total, prepend=0.0), False


Steps = Generator[Ask, list, Any]


def cut(ask: Ask, count: float, budget: float, got: list | None = None) -> Steps:
    """The first key that doesn't fit, in order, with what all before it are: (key, items, bits). All fit: (ALL, items, bits)."""
    while True:
        got = got or (yield ask)
        n0, b0 = sum(r["below"][0] for r in got), sum(r["below"][1] for r in got)
        key, tie, n, b = (np.concatenate([r["points"][k] for r in got]) for k in range(4))
        chunk = np.repeat(np.arange(len(got)), [len(r["points"][0]) for r in got])
        order = np.lexsort((tie, key))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        # A key of many items may have some of them as soon as its chunk's key before has passed.
        prior = np.where(np.diff(chunk, prepend=-1) != 0, -1, np.roll(rank, 1)) if len(rank) else rank
        early = np.where(n > 1, prior + 1, rank)
        at_least = [np.cumsum(x[order]) for x in (n, b)]
        at_most = [np.cumsum(np.bincount(early, x, len(order))) for x in (n, b)]
        fails = np.flatnonzero((n0 + at_least[0] > count) | (b0 + at_least[1] > budget))
        if not len(fails):
            return ALL, n0 + int(n.sum()), b0 + float(b.sum())
        k = int(fails[0])
        if (n == 1).all():
            return (float(key[order[k]]), int(tie[order[k]])), n0 + (int(at_least[0][k - 1]) if k else 0), b0 + (float(at_least[1][k - 1]) if k else 0.0)
        fits = np.flatnonzero((n0 + at_most[0] <= count) & (b0 + at_most[1] <= budget))
        lo = ask.lo
        if len(fits):
            lo = (float(key[order[fits[-1]]]), int(tie[order[fits[-1]]]))
        ask, got = Ask(ask.w, ask.stage, order=ask.order, lo=lo, hi=(float(key[order[k]]), int(tie[order[k]]))), None


def tail(w: int, after: tuple, bits_left: float, items_left: float, least: float) -> Steps:
    """Places of what a walk still takes behind its first item that didn't fit."""
    taken, head = [], 64
    while items_left >= 1 and bits_left >= least:
        got = yield Ask(w, "scored", order="value", lo=after, most_bits=bits_left, head=head)
        key, tie, b = (np.concatenate([r["points"][k] for r in got]) for k in (0, 1, 3))
        known = min(((float(r["points"][0][-1]), int(r["points"][1][-1])) for r in got if r["points"][4]), default=ALL)
        for i in np.lexsort((tie, key)).tolist():
            here = (float(key[i]), int(tie[i]))
            if here > known:
                break
            after = here
            if b[i] <= bits_left and items_left >= 1:
                taken.append(here[1])
                bits_left, items_left = bits_left - float(b[i]), items_left - 1
        if known == ALL:
            break
        head = min(4096, 2 * head)
    return np.array(taken, np.int64)


def steer(m: Mission, r: Course, fit, memo: dict) -> Steps:
    """A run's windows, one after another; returns its records (without lists) and its summary."""
    cfg, needs = r.cfg, r.method in SCORE_BASED
    n_windows = max(1, len(m.plan))
    cycles_budget = cfg.cycles_per_window or m.n / n_windows * (cfg.provisioned_cycles or cfg.cycles_per_score) * cfg.compute_fraction
    mean_bits = m.bits / m.n
    reserve = min(float(np.ceil(r.bits_budget / mean_bits)) * cfg.compress_cycles, cycles_budget)
    running, history, model = Running(), "model", None
    booted, refits, drawn, arrived = cfg.adaptation == "frozen", 0, 0, 0
    t = {"available": 0, "used": 0.0, "lost": 0, "lost_natural": 0, "unscored": 0, "first_held": 0, "first_held_natural": 0, "news": 0, "news_natural": 0}
    sent, sent_bits, records, open_ = [0, 0, 0], [0.0, 0.0, 0.0], [], None

    def finish(record: dict, found: list[dict]) -> None:
        total = lambda k: sum(x[k] for x in found)
        of, bits_of = ([sum(x[k][i] for x in found) for i in range(3)] for k in ("of", "bits_of"))
        used, used_cycles = sum(bits_of), sum(of) * cfg.compress_cycles
        for i in range(3):
            sent[i] += of[i]
            sent_bits[i] += bits_of[i]
        t["used"] += used
        for k in ("first_held", "first_held_natural", "news", "news_natural"):
            t[k] += total(k)
        bound = "cycles"
        if total("eligible"):
            bits = max(x["left_most"] for x in found) > r.bits_budget - used + 1e-9
            cycles = total("left") > 0 and cfg.compress_cycles > record.pop("_allowance") - used_cycles + 1e-9
            bound = "both" if bits and cycles else "bits" if bits else "cycles" if cycles else "neither"
        record.pop("_allowance", None)
        held_natural = scored_natural = None
        if needs and record["n_unscored"] and total("held_natural"):
            held_natural, scored_natural = total("held_natural"), total("scored_natural")
        available = record.pop("_available")
        records.append(
            record | {
                "n_selected": sum(of), "bits_used": used, "cycles_used": record["cycles_prefilter"] + record["cycles_scoring"] + used_cycles, "binding_constraint": bound,
                "sent_natural": of[0], "sent_rover": of[1], "sent_typical": of[2], "bits_natural": sent_bits[0], "bits_rover": sent_bits[1], "bits_typical": sent_bits[2],
                "cum_sent_natural": sent[0], "cum_natural_available": available, "cum_science_yield": sent[0] / available if available else 0.0,
                "cum_wasted_bit_share": sent_bits[1] / t["used"] if t["used"] > 0 else 0.0, "prefilter_recall": scored_natural / held_natural if held_natural else None,
                "prefilter_scored_natural": scored_natural, "prefilter_buffered_natural": held_natural,
            }
        )

    for w, a in enumerate(m.plan):
        p = Passed(a.now, Running(running.n, running.mean, running.m2), model=model)
        p.reset = cfg.adaptation == "online" and needs and (not booted and a.now >= cfg.bootstrap_sols or booted and cfg.refit_every > 0 and w % cfg.refit_every == 0)
        r.past.append(p)
        arrived += a.n
        t["available"] += a.natural
        got = yield Ask(w, "kept", open_ is not None, "z" if needs else None)
        if open_ is not None:
            finish(open_, [x["result"] for x in got if "result" in x])
            open_ = None
        count = lambda k, got: sum(x["kept"][k] for x in got)
        n_old, n_over = count("old", got), max(0, count("held", got) - cfg.capacity) if cfg.capacity is not None else 0
        t["lost"] += n_old + n_over
        t["lost_natural"] += count("old_natural", got)
        if n_over:
            edge, *_ = yield from cut(Ask(w, "kept", order="place"), n_over, np.inf)
            p.evict = edge[1]
            got = yield Ask(w, "kept", order="z" if needs else None)
            t["lost_natural"] += count("over_natural", got)
        held = count("held", got)
        if not held:
            p.skip, p.reset = True, False
            continue
        if p.reset:
            pool, behind, step = [], [k for k, c in enumerate(m.chunks) if c[2] < arrived], 1
            near = [k for k in behind if m.chunks[k][2] + m.chunks[k][3] > arrived - cfg.refit_max]
            while near:
                found = yield Ask(w, "kept", pool=cfg.refit_max, chunks=near)
                pool = [x["pool"] for x in found] + pool
                behind = behind[: -len(near)]
                near = behind[-step:] if sum(len(x["idx"]) for x in pool) < cfg.refit_max and cfg.ground_feedback else []
                step *= 2
            both = {k: None if pool[0][k] is None else np.concatenate([x[k] for x in pool])[-cfg.refit_max :] for k in ("idx", "stats", "features")}
            history = chain(history, both["idx"].tolist(), cfg.seed)
            if len(both["idx"]) >= cfg.refit_least:
                if history not in memo:
                    memo[history] = fit.learn(Rows(both["stats"], both["features"]))
                model = p.model = memo[history]
            booted, refits = True, refits + 1
        batch = Running()
        for x in got:
            batch = _merged(batch, x["kept"]["moved"])
        n_fresh, left = batch.n, cycles_budget - reserve - batch.n * cfg.prefilter_cycles
        n_scored = n_unscored = 0
        eligible = held
        if needs:
            waiting = count("waiting", got)
            can = waiting if cfg.unlimited_compute or not cfg.cycles_per_score else int(max(0.0, left) // cfg.cycles_per_score)
            n_scored = min(can, waiting)
            n_unscored = waiting - n_scored
            t["unscored"] += n_unscored
            p.scored = ALL if can >= waiting else NONE if not can else (yield from cut(Ask(w, "kept", order="z"), can, np.inf, got))[0]
            left -= n_scored * cfg.cycles_per_score
        elif r.method == "random":
            undated, at = sum(x["kept"]["held_undated"] for x in got), [drawn, 0]
            at[1] = drawn + undated
            for x in got:
                u = x["kept"]["held_undated"]
                p.drawn[x["no"]] = (at[0], at[1])
                at = [at[0] + u, at[1] + x["kept"]["held"] - u]
            drawn += held
        running = _merged(running, batch)
        p.allowance = max(reserve + max(left, 0.0), cfg.compress_cycles)
        fit_items = np.inf
        if cfg.compress_cycles > 0:
            fit_items = np.floor(p.allowance / cfg.compress_cycles)
            fit_items += float((fit_items + 1) * cfg.compress_cycles <= p.allowance) - float(fit_items * cfg.compress_cycles > p.allowance)
        if eligible:
            ask = Ask(w, "scored", order="value")
            got = yield ask
            if r.method in ("greedy_ratio", "oracle") and not any(x["positive"] for x in got):
                p.bump = 1e-12
                got = None
            edge, items, bits = yield from cut(ask, fit_items, r.bits_budget, got)
            if edge != ALL:
                p.extra = yield from tail(w, edge, r.bits_budget - bits, fit_items - items, m.least)
            p.sent = edge
        open_ = {
            "window": w, "first_sol": a.first if a.first >= 0 else -1, "last_sol": a.now if a.first >= 0 else -1, "method": r.method, "n_arrived": a.n, "n_buffered": held, "n_prefiltered": n_fresh, "n_scored": n_scored, "n_unscored": n_unscored,
            "n_expired": n_old, "n_evicted": n_over, "bits_budget": r.bits_budget, "cycles_budget": cycles_budget, "cycles_scoring": n_scored * cfg.cycles_per_score, "cycles_prefilter": n_fresh * cfg.prefilter_cycles, "refit": p.reset,
            "_allowance": p.allowance, "_available": t["available"],
        }
        if w == len(m.plan) - 1:
            got = yield Ask(w, "sent", True)
            finish(open_, [x["result"] for x in got if "result" in x])
    n_sent, was = sum(sent), t["first_held_natural"]
    return records, {
        "method": r.method, "windows": len(records), "science_yield": sent[0] / m.natural if m.natural else 0.0, "wasted_bit_share": sent_bits[1] / t["used"] if t["used"] > 0 else 0.0,
        "n_expired": t["lost"], "n_expired_natural": t["lost_natural"], "n_unscored": t["unscored"], "n_sent": n_sent, "n_sent_natural": sent[0], "n_sent_rover": sent[1], "n_sent_typical": sent[2],
        "n_natural_total": m.natural, "bits_used": t["used"], "bits_available": r.bits_budget * len(m.plan), "precision_natural": sent[0] / n_sent if n_sent else 0.0, "n_refits": refits,
        "prefilter_recall_natural": t["news_natural"] / was if was else 1.0, "n_natural_never_scored": was - t["news_natural"], "n_frames_never_scored": t["first_held"] - t["news"],
        "n_remaining": m.n - t["lost"] - n_sent, "scores_affordable_per_window": cycles_budget / cfg.cycles_per_score if cfg.cycles_per_score else None,
    }


def _merged(a: Running, b: Running) -> Running:
    if not a.n or not b.n:
        return b if not a.n else a
    delta, n = b.mean - a.mean, a.n + b.n
    return Running(n, a.mean + delta * b.n / n, a.m2 + b.m2 + delta**2 * a.n * b.n / n)


# ---- jobs


def _chunk(row: pa.RecordBatch, no: int, start: int, total: int, starts: np.ndarray) -> Chunk:
    """A stored row with its number, its first place, the mission's frames and the first days of its windows."""
    of = lambda c, t: np.frombuffer(row.column(c)[0].as_py(), t)
    idx, sol = of("idx", np.int64), of("sol", np.int64)
    pos = np.arange(start, start + len(idx))
    win = np.where(sol >= 0, np.searchsorted(starts, sol, "right") - 1, len(starts))
    wide = of("features", float).reshape(len(idx), -1) if "features" in row.schema.names else None
    return Chunk(no, idx, sol, of("grp", np.int8), of("bits", float), of("stats", float).reshape(len(idx), -1), of("score", float), wide, np.where(sol >= 0, pos, pos - total), win)


class Voyages:
    """All runs over all missions of ``frames``, played; see the module."""

    def __init__(self, frames: DataFrame, runs: list[tuple[str, str, Config]], by: list[str], fit, n: int, share: bool = True):
        self.spark, self.runs, self.by, self.fit = with_workers(frames.sparkSession), runs, by, fit
        widths = frames.select(F.size("stats").alias("s"), (F.size("features") if "features" in frames.columns else F.lit(0)).alias("f")).first()
        self.chunks = packed(frames, by, n, widths.s + widths.f)
        self.kinds = {c: frames.schema[c].dataType.simpleString() for c in by}
        listing = self.chunks.select(*by, "part", "seq", "least", "last", "n", "d_sol", "d_n", "d_bits", "d_natural").collect()  # a row a chunk
        missions: dict[tuple, list] = {}
        for row in listing:
            missions.setdefault(tuple(row[c] for c in by), []).append(row)
        self.missions, self.courses = [], []
        lengths = sorted({c.sols_per_window for _, _, c in runs})
        for key, rows in missions.items():
            planned = {s: Mission.of(key, rows, s) for s in lengths}
            memo: dict = {}
            for k, (_, method, cfg) in enumerate(runs):
                m = planned[cfg.sols_per_window]
                budget = cfg.bits_per_window or m.bits / max(1, len(m.plan)) * cfg.downlink_fraction
                self.missions.append(m)
                self.courses.append((k, Course(method, cfg, budget), memo if share else {}))
        self.records: list[dict] = []
        self.summaries: list[dict] = []
        self._play()

    def _play(self) -> None:
        steps = [steer(m, c, self.fit, memo) for m, (_, c, memo) in zip(self.missions, self.courses, strict=True)]
        asks = {v: next(s) for v, s in enumerate(steps)}
        while asks:
            replies, asks_now = self._answered(asks), asks
            asks = {}
            for v in asks_now:
                try:
                    asks[v] = steps[v].send(replies[v])
                except StopIteration as end:
                    key = dict(zip(self.by, self.missions[v].key, strict=True)) | {"run_no": self.courses[v][0]}
                    records, summary = end.value
                    self.records += [key | x for x in records]
                    self.summaries.append(key | summary)

    def _wanted(self, wants: dict[int, list[int]]) -> tuple[dict, DataFrame]:
        """Which voyages want each chunk, and the chunks."""
        at: dict[tuple, list] = {}
        for v, numbers in wants.items():
            m = self.missions[v]
            for k in numbers:
                part, seq, start, *_ = m.chunks[k]
                at.setdefault((part, seq), []).append((v, k, start, m.n, m.starts))
        return at, self.chunks.filter(F.col("part").isin(sorted({p for p, _ in at}))).drop("least", "last", "n", "d_sol", "d_n", "d_bits", "d_natural")

    def _answered(self, asks: dict[int, Ask]) -> dict[int, list]:
        at, some = self._wanted({v: a.chunks if a.chunks is not None else self.missions[v].alive(a.w, self.courses[v][1].cfg.max_age) for v, a in asks.items()})
        most = min(256, max(16, KEYS // max(1, sum(map(len, at.values())))))
        courses, fit = {v: self.courses[v][1] for v in asks}, self.fit

        def run(batches):
            for batch in batches:
                out: list[tuple[int, bytes]] = []
                for i in range(batch.num_rows):
                    row, memos = batch.slice(i, 1), {}
                    key = (row.column("part")[0].as_py(), row.column("seq")[0].as_py())
                    for v, *known in at.get(key, ()):
                        length = courses[v].cfg.sols_per_window
                        if length not in memos:
                            memos[length] = _chunk(row, *known)
                        c = memos[length]
                        found = fate(c, courses[v], asks[v], fit)
                        if "points" in found:
                            found["points"] = _thin(found["points"], most, asks[v].head)
                        out.append((v, pickle.dumps(found | {"no": c.no})))
                yield pa.RecordBatch.from_arrays([pa.array([v for v, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], names=["v", "reply"])

        replies: dict[int, list] = {v: [] for v in asks}
        for r in some.mapInArrow(run, "v int, reply binary").collect():  # sums and at most about KEYS keys
            replies[r.v].append(pickle.loads(r.reply))
        return {v: sorted(x, key=lambda y: y["no"]) for v, x in replies.items()}

    def lists(self) -> DataFrame:
        """by, run_no, window, selected_indices (in the walk's order), lost_indices (expired, then evicted): a row a window that has any."""
        at, some = self._wanted({v: list(range(len(m.chunks))) for v, m in enumerate(self.missions)})
        courses, fit = {v: c for v, (_, c, _) in enumerate(self.courses)}, self.fit
        last = {v: len(m.plan) - 1 for v, m in enumerate(self.missions)}
        parts = ("sent", "key", "sent_place", "old", "over", "over_place")

        def run(batches):
            for batch in batches:
                for i in range(batch.num_rows):
                    row = batch.slice(i, 1)
                    key = (row.column("part")[0].as_py(), row.column("seq")[0].as_py())
                    for v, *known in at.get(key, ()):
                        c, listed = _chunk(row, *known), {}
                        fate(c, courses[v], Ask(last[v], "sent"), fit, listed)
                        if listed:
                            blobs = [[np.asarray(x.get(k, []), float if k == "key" else np.int64).tobytes() for x in listed.values()] for k in parts]
                            yield pa.RecordBatch.from_arrays([pa.array([v] * len(listed), pa.int32()), pa.array(list(listed), pa.int64()), pa.array([c.no] * len(listed), pa.int32()), *(pa.array(b, pa.binary()) for b in blobs)], names=["v", "window", "no", *parts])

        def whole(t: pa.Table) -> pa.Table:
            t = t.take(pa.array(np.argsort(t.column("no").to_numpy())))
            sent, key, place, old, over, over_place = (np.concatenate([np.frombuffer(x.as_py(), float if k == "key" else np.int64) for x in t.column(k)]) for k in parts)
            lost = np.concatenate([old, over[np.argsort(over_place, kind="stable")]])
            one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x))
            return pa.table({"v": t.column("v").slice(0, 1), "window": t.column("window").slice(0, 1), "selected_indices": one(sent[np.lexsort((place, key))]), "lost_indices": one(lost)})

        each = some.mapInArrow(run, "v int, window long, no int, " + ", ".join(f"{k} binary" for k in parts))
        found = each.groupBy("v", "window").applyInArrow(whole, "v int, window long, selected_indices array<bigint>, lost_indices array<bigint>")
        keyed = "".join(f"`{c}` {k}, " for c, k in self.kinds.items())
        names = self.spark.createDataFrame([(*m.key, k, v) for v, (m, (k, *_)) in enumerate(zip(self.missions, self.courses, strict=True))], f"{keyed}run_no int, v int")
        return found.join(F.broadcast(names), "v").drop("v")  # a row a run
