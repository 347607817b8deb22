"""The window-by-window replay of a mission under one policy and two budgets.

Each window depends on what earlier ones sent, so a run is sequential; runs (policies, budgets, tiers) are
groups that execute in parallel, and a run carries only ids, days, groups, bits, statistics and scores.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .prefilter import residual_norms
from .selection import binding, ordered, walk

#: Policies, and which of them need scores.
POLICIES = ("fifo", "random", "score_first", "greedy_ratio", "oracle")
SCORE_BASED = ("score_first", "greedy_ratio")


@dataclass(frozen=True)
class Config:
    sols_per_window: int = 50
    downlink_fraction: float = 0.25
    compute_fraction: float = 1.0
    bits_per_window: float | None = None
    cycles_per_window: float | None = None
    max_age: int = 200
    capacity: int | None = None
    adaptation: str = "frozen"
    bootstrap_sols: int = 200
    refit_every: int = 4
    refit_max: int = 4000
    refit_least: int = 8
    ground_feedback: bool = False
    cycles_per_score: float = 2_599_296.0
    provisioned_cycles: float | None = None  # what the hardware was sized for; None: this model's own cost
    prefilter_cycles: float = 0.0
    compress_cycles: float = 147_456.0
    unlimited_compute: bool = False
    seed: int = 0

    def __post_init__(self):
        if not 0 < self.downlink_fraction <= 1 or self.compute_fraction <= 0 or self.sols_per_window < 1:
            raise ValueError("fractions must be positive (downlink at most 1), windows at least a day long")
        if self.adaptation not in ("frozen", "online"):
            raise ValueError("adaptation is frozen or online")
        if self.ground_feedback and self.adaptation != "online":
            raise ValueError("ground feedback needs online adaptation")


def plan_windows(sol: np.ndarray, length: int) -> list[np.ndarray]:
    """Positions of each anchored window's frames; undated (sol < 0) frames come last."""
    out, dated = [], np.flatnonzero(sol >= 0)
    days = sol[dated]
    at = 0
    while at < len(dated):
        to = int(np.searchsorted(days, days[at] + length, "left"))
        out.append(dated[at:to])
        at = to
    undated = np.flatnonzero(sol < 0)
    return [*out, undated] if len(undated) else out


@dataclass
class Running:
    """Counts, means and squared deviations of the statistics seen so far."""

    n: int = 0
    mean: np.ndarray = field(default_factory=lambda: np.zeros(0))
    m2: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def z(self, x: np.ndarray) -> np.ndarray:
        if self.n < 2:
            return np.zeros(len(x))
        return (np.abs(x - self.mean) / np.sqrt(np.maximum(self.m2 / (self.n - 1), 1e-12))).sum(1)

    def add(self, x: np.ndarray) -> None:
        n, mean = len(x), x.mean(0)
        if not self.n:
            self.n, self.mean, self.m2 = n, mean, ((x - mean) ** 2).sum(0)
            return
        delta, total = mean - self.mean, self.n + n
        self.m2 = self.m2 + ((x - mean) ** 2).sum(0) + delta**2 * self.n * n / total
        self.mean, self.n = self.mean + delta * n / total, total


def chain(previous: str, pool: list[int], seed: int) -> str:
    """Identity of a model after one more refit."""
    return hashlib.sha256(previous.encode() + np.sort(np.array(pool, np.int64)).tobytes() + str(seed).encode()).hexdigest()


def _last_unfed(seen: list[int], fed_back: np.ndarray, most: int) -> list[int]:
    """The last frames seen that weren't fed back, in order; looks only as far back as it must."""
    back = most
    while True:
        pool = [i for i in seen[-back:] if not fed_back[i]]
        if len(pool) >= most or back >= len(seen):
            return pool[-most:]
        back *= 2


Model = Callable[[np.ndarray], np.ndarray]


@dataclass
class Frames:
    """A mission in order: day (undated: -1), index, group, bits, statistics (n x k), and scores or features."""

    idx: np.ndarray
    sol: np.ndarray
    group: np.ndarray
    bits: np.ndarray
    stats: np.ndarray
    score: np.ndarray
    features: np.ndarray | None = None


def replay(f: Frames, method: str, cfg: Config, fit: Callable[[np.ndarray], Model] | None = None, memo: dict | None = None) -> tuple[list[dict], dict]:
    """Window records and the run's summary. ``fit`` makes a scorer from the positions of a refit's pool."""
    if method not in POLICIES:
        raise ValueError(f"unknown policy {method}")
    plan, n, memo = plan_windows(f.sol, cfg.sols_per_window), len(f.idx), {} if memo is None else memo
    natural, rover = f.group == "natural", f.group == "rover"
    n_windows = max(1, len(plan))
    bits_budget = cfg.bits_per_window or float(f.bits.sum()) / n_windows * cfg.downlink_fraction
    cycles_budget = cfg.cycles_per_window or n / n_windows * (cfg.provisioned_cycles or cfg.cycles_per_score) * cfg.compute_fraction
    mean_bits = float(f.bits.mean()) if n else 1.0
    needs, rng = method in SCORE_BASED, np.random.default_rng(cfg.seed)
    held, lost_natural, lost = np.zeros(n, bool), 0, 0
    prefilter, cached = np.full(n, np.nan), np.full(n, np.nan)
    scorer: Model = lambda at: f.score[at]
    running, seen, fed_back, history = Running(), [], np.zeros(n, bool), "model"
    booted, refits, unscored_total = cfg.adaptation == "frozen", 0, 0
    sent, sent_bits, used_total = {"natural": 0, "rover": 0, "typical": 0}, {"natural": 0.0, "rover": 0.0, "typical": 0.0}, 0.0
    available, ever_held, ever_scored, records = 0, np.zeros(n, bool), np.zeros(n, bool), []
    for w, arriving in enumerate(plan):
        now = int(f.sol[arriving].max())
        held[arriving] = True
        seen += arriving.tolist()
        available += int(natural[arriving].sum())
        # Arrivals come before expiry, which looks at the newest arrival's day.
        old = np.flatnonzero(held & (np.maximum(now - f.sol, 0) > cfg.max_age))
        held[old] = False
        keep = np.flatnonzero(held)
        over = keep[:0] if cfg.capacity is None else keep[np.lexsort((f.idx[keep], f.sol[keep]))][: max(0, len(keep) - cfg.capacity)]
        held[over] = False
        gone = np.concatenate([old, over])
        lost += len(gone)
        lost_natural += int(natural[gone].sum())
        candidates = np.flatnonzero(held)
        candidates = candidates[np.lexsort((f.idx[candidates], f.sol[candidates]))]
        if not len(candidates):
            continue
        refit = False
        if cfg.adaptation == "online" and needs and (not booted and now >= cfg.bootstrap_sols or booted and cfg.refit_every > 0 and w % cfg.refit_every == 0):
            pool = _last_unfed(seen, fed_back, cfg.refit_max)
            history = chain(history, [int(f.idx[i]) for i in pool], cfg.seed)
            if len(pool) >= cfg.refit_least and fit is not None:
                if history not in memo:
                    memo[history] = fit(np.sort(np.array(pool)))
                scorer = memo[history]
            cached[:] = np.nan
            booted = refit = True
            refits += 1
        reserve = min(float(np.ceil(bits_budget / mean_bits)) * cfg.compress_cycles, cycles_budget)
        left = cycles_budget - reserve
        fresh = candidates[np.isnan(prefilter[candidates])]
        if len(fresh):
            prefilter[fresh] = running.z(f.stats[fresh])
            running.add(f.stats[fresh])
        prefilter_cost = len(fresh) * cfg.prefilter_cycles
        left -= prefilter_cost
        n_scored = n_unscored = 0
        eligible = candidates
        if needs:
            waiting = candidates[np.isnan(cached[candidates])]
            waiting = waiting[np.lexsort((f.idx[waiting], -prefilter[waiting]))]
            can = len(waiting) if cfg.unlimited_compute or not cfg.cycles_per_score else int(max(0.0, left) // cfg.cycles_per_score)
            now_scored = waiting[:can]
            n_scored, n_unscored = len(now_scored), len(waiting) - len(now_scored)
            unscored_total += n_unscored
            ever_held[candidates] = True
            if n_scored:
                cached[now_scored] = scorer(now_scored)
                ever_scored[now_scored] = True
                left -= n_scored * cfg.cycles_per_score
            eligible = candidates[~np.isnan(cached[candidates])]
        has_score = ~np.isnan(cached[candidates])
        used_bits = used_cycles = 0.0
        chosen, bound = eligible[:0], "cycles"
        if len(eligible):
            b, c = f.bits[eligible], np.full(len(eligible), cfg.compress_cycles)
            allowance = max(reserve + max(left, 0.0), cfg.compress_cycles)
            value, how = {
                "fifo": lambda: (-(f.sol[eligible] * 10_000.0 + f.idx[eligible]), "score_first"),
                "random": lambda: (rng.random(len(eligible)), "score_first"),
                "score_first": lambda: (cached[eligible], "score_first"),
                "greedy_ratio": lambda: (cached[eligible], "greedy_ratio"),
                "oracle": lambda: (natural[eligible].astype(float), "greedy_ratio"),
            }[method]()
            if how == "greedy_ratio" and not (value > 0).any():
                value = value + 1e-12
            taken = walk(ordered(value, b, c, bits_budget, allowance, how), b, c, bits_budget, allowance)
            bound = binding(b, c, taken, bits_budget, allowance)
            chosen = eligible[taken]
            used_bits, used_cycles = float(b[taken].sum()), float(c[taken].sum())
        kind = np.where(natural[chosen], "natural", np.where(rover[chosen], "rover", "typical"))
        of = {k: int((kind == k).sum()) for k in sent}
        for k in sent:
            sent[k] += of[k]
            sent_bits[k] += float(f.bits[chosen][kind == k].sum())
        used_total += used_bits
        held[chosen] = False
        cached[chosen] = np.nan
        if cfg.ground_feedback:
            fed_back[chosen[f.group[chosen] != "typical"]] = True
        recall = scored_natural = held_natural = None
        if needs and n_unscored and natural[candidates].any():
            held_natural, scored_natural = int(natural[candidates].sum()), int((natural[candidates] & has_score).sum())
            recall = scored_natural / held_natural
        dated = f.sol[arriving[0]] >= 0
        records.append(
            {
                "window": w, "first_sol": int(f.sol[arriving[0]]) if dated else -1, "last_sol": now if dated else -1, "method": method,
                "n_arrived": len(arriving), "n_buffered": len(candidates), "n_prefiltered": len(fresh), "n_scored": n_scored, "n_unscored": n_unscored,
                "n_selected": len(chosen), "n_expired": len(old), "n_evicted": len(over), "bits_budget": bits_budget, "bits_used": used_bits,
                "cycles_budget": cycles_budget, "cycles_used": prefilter_cost + n_scored * cfg.cycles_per_score + used_cycles,
                "cycles_scoring": n_scored * cfg.cycles_per_score, "cycles_prefilter": prefilter_cost, "binding_constraint": bound,
                "sent_natural": of["natural"], "sent_rover": of["rover"], "sent_typical": of["typical"],
                "bits_natural": sent_bits["natural"], "bits_rover": sent_bits["rover"], "bits_typical": sent_bits["typical"],
                "cum_sent_natural": sent["natural"], "cum_natural_available": available, "cum_science_yield": sent["natural"] / available if available else 0.0,
                "cum_wasted_bit_share": sent_bits["rover"] / used_total if used_total > 0 else 0.0, "refit": refit, "prefilter_recall": recall,
                "prefilter_scored_natural": scored_natural, "prefilter_buffered_natural": held_natural,
                "selected_indices": f.idx[chosen].tolist(), "lost_indices": f.idx[gone].tolist(),
            }
        )
    n_sent, n_natural = sum(sent.values()), int(natural.sum())
    was = int((ever_held & natural).sum())
    summary = {
        "method": method, "windows": len(records), "science_yield": sent["natural"] / n_natural if n_natural else 0.0, "wasted_bit_share": sent_bits["rover"] / used_total if used_total > 0 else 0.0,
        "n_expired": lost, "n_expired_natural": lost_natural, "n_unscored": unscored_total, "n_sent": n_sent, "n_sent_natural": sent["natural"], "n_sent_rover": sent["rover"], "n_sent_typical": sent["typical"],
        "n_natural_total": n_natural, "bits_used": used_total, "bits_available": bits_budget * len(plan), "precision_natural": sent["natural"] / n_sent if n_sent else 0.0, "n_refits": refits,
        "prefilter_recall_natural": int((ever_scored & natural).sum()) / was if was else 1.0, "n_natural_never_scored": was - int((ever_scored & ever_held & natural).sum()),
        "n_frames_never_scored": int((ever_held & ~ever_scored).sum()), "n_remaining": int(held.sum()), "scores_affordable_per_window": cycles_budget / cfg.cycles_per_score if cfg.cycles_per_score else None,
    }
    return records, summary


RECORD = (
    "window bigint, first_sol bigint, last_sol bigint, method string, n_arrived bigint, n_buffered bigint, n_prefiltered bigint, n_scored bigint, n_unscored bigint, n_selected bigint, n_expired bigint, n_evicted bigint, "
    "bits_budget double, bits_used double, cycles_budget double, cycles_used double, cycles_scoring double, cycles_prefilter double, binding_constraint string, sent_natural bigint, sent_rover bigint, sent_typical bigint, "
    "bits_natural double, bits_rover double, bits_typical double, cum_sent_natural bigint, cum_natural_available bigint, cum_science_yield double, cum_wasted_bit_share double, refit boolean, prefilter_recall double, "
    "prefilter_scored_natural bigint, prefilter_buffered_natural bigint, selected_indices array<bigint>, lost_indices array<bigint>"
)
SUMMARY = (
    "method string, windows bigint, science_yield double, wasted_bit_share double, n_expired bigint, n_expired_natural bigint, n_unscored bigint, n_sent bigint, n_sent_natural bigint, n_sent_rover bigint, n_sent_typical bigint, "
    "n_natural_total bigint, bits_used double, bits_available double, precision_natural double, n_refits bigint, prefilter_recall_natural double, n_natural_never_scored bigint, n_frames_never_scored bigint, n_remaining bigint, scores_affordable_per_window double"
)


def frames_of(table: pa.Table) -> Frames:
    """A run's rows (idx, sol, grp, bits, stats, score, features if any) in mission order: by day, undated last, then index."""
    idx, sol = table.column("idx").to_numpy(), table.column("sol").fill_null(-1).to_numpy()
    order = np.lexsort((idx, sol, sol < 0))

    def wide(name: str) -> np.ndarray:
        values = table.column(name).combine_chunks()
        return np.asarray(values.flatten(), float).reshape(len(idx), -1)[order]

    features = wide("features") if "features" in table.column_names and table.column("features").null_count < len(idx) else None
    return Frames(idx[order], sol[order], np.array(table.column("grp").to_pylist(), dtype=object)[order], table.column("bits").to_numpy()[order], wide("stats"), table.column("score").to_numpy()[order], features)


Fit = Callable[[np.ndarray], Model]


@dataclass
class Rows:
    """Statistics, and features if any, of some frames."""

    stats: np.ndarray
    features: np.ndarray | None


@dataclass(frozen=True)
class Refit:
    """A refit in two steps: ``learn`` makes a model of a pool's rows, ``apply(model, rows)`` scores any rows by it."""

    learn: Callable[[Rows], tuple]
    apply: Callable[[tuple, Rows], np.ndarray]
    wide: bool = False

    def __call__(self, f: Frames) -> Fit:
        if self.wide and f.features is None:
            raise ValueError("a refit of principal components needs frames with features")
        rows = lambda at: Rows(f.stats[at], None if f.features is None else f.features[at])

        def fit(pool: np.ndarray) -> Model:
            model = self.learn(rows(pool))
            return lambda at: self.apply(model, rows(at))

        return fit


def _scales(pool: Rows) -> tuple:
    return pool.stats.mean(0), np.maximum(pool.stats.std(0), 1e-6)


#: A refit for the replay on statistics: novelty is the distance from the pool's mean in its own scales.
nearest_to_mean = Refit(_scales, lambda model, rows: np.abs((rows.stats - model[0]) / model[1]).sum(1))


def principal(k: int = 8) -> Refit:
    """A refit of principal components on the pool's features: novelty is the residual off the first ``k``."""

    def learn(pool: Rows) -> tuple:
        mean = pool.features.mean(0)
        return mean, np.linalg.svd(pool.features - mean, full_matrices=False)[2][:k]

    return Refit(learn, lambda model, rows: residual_norms(rows.features, *model)[0], wide=True)


def lane(method: str, cfg: Config, k: int) -> tuple:
    """Runs with equal lanes refit on the same pools whatever their budgets, so they share refits; any other run is alone."""
    if cfg.adaptation != "online" or method not in SCORE_BASED or cfg.ground_feedback:
        return ("alone", k)
    return ("online", cfg.seed, cfg.sols_per_window, cfg.bootstrap_sols, cfg.refit_every, cfg.refit_max, cfg.refit_least)


#: Frames of a mission that one task may hold; longer missions are played by chunks.
WHOLE = 250_000
LISTS = ("selected_indices", "lost_indices")


def run_all(frames: DataFrame, runs: list[tuple[str, str, Config]], log: bool = True, by: list[str] | None = None, fit: Callable[[Frames], Fit] = nearest_to_mean, share: bool = True, lists: bool = True, whole: int = WHOLE) -> DataFrame:
    """One replay for each (name, method, config), over each mission of ``frames`` (all of them, or one for each value of ``by``).

    A log without ``lists`` has no columns of indices. Missions of up to ``whole`` frames and their lanes are dealt to
    tasks; such a mission is copied once for each lane, not for each run. The runs of a lane go one after another and
    share one memo of refits (``share``), which changes no result: a refit's key is the chain of pools that led to it.
    Longer missions are played by chunks (``long_replay``).
    """
    return _played(frames, runs, by or [], fit, share, lists, whole)[0 if log else 1]()


def logs_and_summaries(frames: DataFrame, runs: list[tuple[str, str, Config]], by: list[str] | None = None, fit: Callable[[Frames], Fit] = nearest_to_mean, lists: bool = False, whole: int = WHOLE) -> tuple[DataFrame, DataFrame]:
    """Both tables of ``run_all``; a mission that is played by chunks is played once for both."""
    log, summary = _played(frames, runs, by or [], fit, True, lists, whole)
    return log(), summary()


def _played(frames: DataFrame, runs: list, by: list[str], fit: Callable, share: bool, lists: bool, whole: int) -> tuple[Callable[[], DataFrame], Callable[[], DataFrame]]:
    spark = frames.sparkSession
    unfit = F.exists("stats", lambda x: F.coalesce(F.isnan(x), F.lit(True))) | F.coalesce(F.isnan("bits") | (F.col("bits") < 0), F.lit(True))
    sizes = frames.groupBy(*by).agg(F.count("*").alias("_n"), F.max(unfit).alias("_unfit"))
    large = sizes.filter((F.col("_n") > whole) & ~F.coalesce("_unfit", F.lit(False))).collect() if isinstance(fit, Refit) else []  # at most a row for ``whole`` frames
    names = spark.createDataFrame([(k, name) for k, (name, _, _) in enumerate(runs)], "run_no int, run string")
    small, found = frames, None
    if large:
        from .long_replay import Voyages

        keys = spark.createDataFrame([tuple(r[c] for c in by) or (0,) for r in large], ", ".join(f"`_l_{c}` {frames.schema[c].dataType.simpleString()}" for c in by) or "_l int")
        same = F.lit(True)
        for c in by:
            same = same & F.col(c).eqNullSafe(F.col(f"_l_{c}"))
        own = frames.join(F.broadcast(keys), same, "left_semi") if by else frames
        small = frames.join(F.broadcast(keys), same, "left_anti") if by else None
        found = Voyages(own, runs, by, fit, sum(r._n for r in large), share)
    keyed = "".join(f"`{c}` {frames.schema[c].dataType.simpleString()}, " for c in by)

    def records() -> DataFrame:
        parts = []
        if small is not None:
            parts.append(_whole(small, runs, True, by, fit, share, lists))
        if found:
            plain = spark.createDataFrame(found.records, f"{keyed}run_no int, {', '.join(c for c in RECORD.split(', ') if c.split(' ')[0] not in LISTS)}")
            if lists:
                on = F.lit(True)
                made = found.lists()
                for c in [*by, "run_no", "window"]:
                    on = on & plain[c].eqNullSafe(made[c])
                none = F.array().cast("array<bigint>")
                plain = plain.join(made, on, "left").select(*(plain[c] for c in plain.columns), *(F.coalesce(made[c], none).alias(c) for c in LISTS))
            parts.append(plain)
        return _named(parts, names)

    def summaries() -> DataFrame:
        parts = [_whole(small, runs, False, by, fit, share, lists)] if small is not None else []
        return _named([*parts, *([spark.createDataFrame(found.summaries, f"{keyed}run_no int, {SUMMARY}")] if found else [])], names)

    return records, summaries


def _named(parts: list[DataFrame], names: DataFrame) -> DataFrame:
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return both.join(F.broadcast(names), "run_no").drop("run_no")  # a row a run


def _whole(frames: DataFrame, runs: list[tuple[str, str, Config]], log: bool, by: list[str], fit: Callable[[Frames], Fit], share: bool, lists: bool) -> DataFrame:
    """Missions that are each one task's."""
    lanes: dict[tuple, list[int]] = {}
    for k, (_, method, cfg) in enumerate(runs):
        lanes.setdefault(lane(method, cfg, k), []).append(k)
    dealt = list(lanes.values()) if share else [[k] for k in range(len(runs))]
    needed = ["idx", "sol", "grp", "bits", "stats", "score", *(["features"] if "features" in frames.columns else [])]
    each = frames.select(*by, *needed, F.explode(F.array(*[F.lit(k) for k in range(len(dealt))])).alias("_lane"))
    refits = [cfg.adaptation == "online" and method in SCORE_BASED for _, method, cfg in runs]
    if "features" in needed:  # runs that never refit get none
        refitting = [k for k, own in enumerate(dealt) if any(refits[r] for r in own)]
        each = each.withColumn("features", F.when(F.col("_lane").isin(refitting), F.col("features")))
    columns = ", ".join(c for c in RECORD.split(", ") if lists or c.split(" ")[0] not in LISTS) if log else SUMMARY
    schema = pa.schema([*[(c, _kind(frames.schema[c].dataType.simpleString())) for c in by], ("run_no", pa.int32()), *_arrow(columns)])

    def go(table: pa.Table) -> pa.Table:
        f, rows, memo = frames_of(table), [], {}
        key = {c: table.column(c)[0].as_py() for c in by}
        for k in dealt[table.column("_lane")[0].as_py()]:
            _, method, cfg = runs[k]
            records, summary = replay(f, method, cfg, fit(f) if refits[k] else None, memo)
            rows += [key | {"run_no": k} | r for r in (records if log else [summary])]
        return pa.Table.from_pylist(rows, schema=schema)

    keyed = "".join(f"`{c}` {frames.schema[c].dataType.simpleString()}, " for c in by)
    return each.groupBy(*by, "_lane").applyInArrow(go, f"{keyed}run_no int, {columns}")


def _kind(name: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "array<bigint>": pa.list_(pa.int64())}[name]


def _arrow(ddl: str):
    return [(c.split(" ")[0], _kind(c.split(" ")[1])) for c in ddl.split(", ")]


def hardware(tier_costs: dict[str, float], reference: str | None) -> dict[str, Config]:
    """A config for each tier; with ``reference`` all are costed on that tier's processor."""
    return {t: replace(Config(), cycles_per_score=c, provisioned_cycles=tier_costs[reference] if reference else None) for t, c in tier_costs.items()}
