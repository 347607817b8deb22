"""Selection under two budgets: greedy walks, their bound, and what stopped them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import with_workers

METHODS = ("score_first", "greedy_ratio", "random")
_PLAN = "total_value double, used_bits double, used_cycles double, selected array<bigint>, n_candidates bigint, binding_constraint string, best_weight double"
#: Rows of whole groups that a task walks at once; cells of a block (groups by weights by items); walks from which a step for all is cheaper than one by one.
ROWS, CELLS, LANES = 1 << 17, 1 << 20, 256


def validated(items: DataFrame) -> DataFrame:
    """Fails at run time on values that aren't finite, negative costs or budgets that aren't positive."""
    bad = F.isnan("v") | F.isnan("b") | F.isnan("c") | F.col("v").isNull() | (F.abs("v") == float("inf")) | (F.col("b") < 0) | (F.col("c") < 0) | (F.col("budget_b") <= 0) | (F.col("budget_c") <= 0)
    return items.filter(F.when(~bad, F.lit(True)).otherwise(F.raise_error(F.lit("values must be finite, costs not negative, budgets positive"))))


def walk(order: np.ndarray, b: np.ndarray, c: np.ndarray, budget_b: float, budget_c: float) -> list[int]:
    """Takes whatever still fits under both budgets, and goes on past what doesn't, until nothing can fit any more."""
    taken, used_b, used_c = [], 0.0, 0.0
    least_b, least_c = (float(x.min()) if len(x) else 0.0 for x in (b, c))
    for i, one_b, one_c in zip(order.tolist(), b[order].tolist(), c[order].tolist(), strict=True):
        if used_b + one_b <= budget_b and used_c + one_c <= budget_c:
            taken.append(i)
            used_b += one_b
            used_c += one_c
        elif used_b + least_b > budget_b or used_c + least_c > budget_c:
            break
    return taken


def binding(b: np.ndarray, c: np.ndarray, taken: list[int], budget_b: float, budget_c: float) -> str:
    """Which budget is too small for something left behind."""
    left = np.ones(len(b), bool)
    left[taken] = False
    bits = bool((b[left] > budget_b - b[taken].sum() + 1e-9).any())
    cycles = bool((c[left] > budget_c - c[taken].sum() + 1e-9).any())
    return "both" if bits and cycles else "bits" if bits else "cycles" if cycles else "neither"


def ordered(v: np.ndarray, b: np.ndarray, c: np.ndarray, budget_b: float, budget_c: float, method: str, weight: float = 0.5, seed: int = 0) -> np.ndarray:
    place = np.arange(len(v))
    if method == "score_first":
        return np.lexsort((place, -v))
    if method == "random":
        return np.random.default_rng(seed).permutation(len(v))
    cost = weight * (b / budget_b) + (1 - weight) * (c / budget_c)
    return np.lexsort((place, -np.divide(v, cost, out=np.full(len(v), np.inf), where=cost > 0)))


def _most(items: DataFrame, keys: list[str]) -> int | None:
    """The most items of one cost that fit any budget, and two more; None where a cut by that isn't worth its ranks.

    It is where it takes an eighth of all items, or more of one group than a task walks at once.
    """
    part = [F.when(F.col(x) > 0, F.floor(F.col(f"budget_{x}") / F.col(x))) for x in ("b", "c")]
    fits = F.least(*part) + 2  # null costs nothing
    each = items.groupBy(*keys, "b", "c").agg(F.count("*").alias("n"), F.max(fits).alias("fits"))
    over = F.greatest(F.lit(0), F.col("n") - F.col("fits"))
    groups = each.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("fits").isNotNull(), over)).alias("over"), F.max("fits").alias("fits"))
    found = groups.agg(F.max("fits").alias("most"), F.sum("n").alias("n"), F.sum("over").alias("over"), F.max("over").alias("hot")).first()
    return found.most if found.over and (8 * found.over >= found.n or found.hot > ROWS) and found.most < 1 << 31 else None


def reachable(items: DataFrame, keys: list[str], method: str) -> DataFrame:
    """Items that a walk by score or by ratio can take, and two more of each cost.

    Items of equal costs come in order, so of each cost no more than fit a budget are ever taken: the ranks beyond are
    cut, as far as Spark can below its shuffle. One more stays for rounding, and one that tells what was left behind.
    Where that takes little, nothing is ranked and all stay.
    """
    most = None if method == "random" else _most(items, keys)
    return items if most is None else _cut(items, keys, method, most)


def _cut(items: DataFrame, keys: list[str], method: str, most: int) -> DataFrame:
    fits = F.least(*[F.when(F.col(x) > 0, F.floor(F.col(f"budget_{x}") / F.col(x))) for x in ("b", "c")]) + 2
    if most > int(items.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000")):
        items.sparkSession.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", str(most))
    if method == "greedy_sweep":
        return _reachable_by_any(items, keys, fits, most)
    by = W.partitionBy(*keys, "b", "c").orderBy(F.desc(_value(items, method)), "idx")
    costly = items.filter("b > 0 or c > 0").withColumn("_r", F.row_number().over(by))
    return costly.filter((F.col("_r") <= most) & (F.col("_r") <= fits)).drop("_r").unionByName(items.filter("not (b > 0 or c > 0)"))


def _reachable_by_any(items: DataFrame, keys: list[str], fits: F.Column, most: int) -> DataFrame:
    """``reachable`` for all weights at once: of equal costs any weight goes by value, or by index where its cost is 0.

    Values that a division may make equal are equal as floats, and rank alike; of those really equal, the first by index stay.
    """
    same = W.partitionBy(*keys, "b", "c")
    near = F.rank().over(same.orderBy(F.desc(F.col("v").cast("float"))))
    alike = F.row_number().over(W.partitionBy(*keys, "b", "c", "v").orderBy("idx"))
    first = F.row_number().over(same.orderBy("idx"))
    short = lambda r: (F.col(r) <= most) & (F.col(r) <= fits)
    costly = items.filter("b > 0 and c > 0").withColumn("_r", near).filter(short("_r")).withColumn("_e", alike).filter(short("_e")).drop("_r", "_e")
    half = items.filter("(b > 0 or c > 0) and not (b > 0 and c > 0)").withColumn("_r", near).withColumn("_e", alike).withColumn("_f", first)
    return costly.unionByName(half.filter(short("_r") & short("_e") | short("_f")).drop("_r", "_e", "_f")).unionByName(items.filter("not (b > 0 or c > 0)"))


def _value(items: DataFrame, method: str) -> F.Column:
    """What a walk goes by, in the arithmetic of ``ordered``."""
    if method == "score_first":
        return F.col("v")
    cost = 0.5 * (F.col("b") / F.col("budget_b")) + 0.5 * (F.col("c") / F.col("budget_c"))
    return F.when(cost > 0, F.col("v") / cost).otherwise(F.lit(float("inf")))


# ---- many groups at once


def _groups(batches, keys: list[str]):
    """Tables of whole groups, of about ``ROWS`` rows or of one group, and where each group starts in them (and the end)."""
    held, starts, size, last = [], [], 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows, bool)
        for k in keys:
            one = batch.column(k)
            before = pa.concat_arrays([(last.column(k) if last else one).slice(0, 1), one.slice(0, batch.num_rows - 1)])
            unlike = pc.fill_null(pc.not_equal(one, before), False).to_numpy(zero_copy_only=False) | (one.is_null().to_numpy(zero_copy_only=False) != before.is_null().to_numpy(zero_copy_only=False))
            if pa.types.is_floating(one.type):
                unlike &= ~pc.fill_null(pc.and_(pc.is_nan(one), pc.is_nan(before)), False).to_numpy(zero_copy_only=False)
            new |= unlike
        new[0] |= last is None
        last, at = batch.slice(batch.num_rows - 1), np.flatnonzero(new)
        if size + batch.num_rows > ROWS and len(at) and size + at[-1]:
            to = int(at[-1])
            yield pa.Table.from_batches([*held, batch.slice(0, to)]).combine_chunks(), np.concatenate([*starts, size + at])
            held, starts, size = [batch.slice(to)], [np.zeros(1, np.int64)], batch.num_rows - to
        else:
            held.append(batch)
            starts.append(size + at)
            size += batch.num_rows
    if held:
        yield pa.Table.from_batches(held).combine_chunks(), np.concatenate([*starts, [size]])


def _together(v: np.ndarray, b: np.ndarray, c: np.ndarray, budget_b: np.ndarray, budget_c: np.ndarray, sizes: np.ndarray, method: str, weights: np.ndarray | None, seed: int) -> tuple:
    """``_alone`` for groups as rows, padded with NaN: the walks of all groups by all weights go on item by item, in step."""
    (g, n), w = v.shape, 1 if weights is None else len(weights)
    rows, pad = np.arange(g), np.arange(n) >= sizes[:, None]
    if method == "random":
        drawn = {k: np.concatenate([ordered(v[0, :k], b[0, :k], c[0, :k], 1.0, 1.0, method, seed=seed), np.arange(k, n)]) for k in np.unique(sizes).tolist()}
        order = np.stack([drawn[k] for k in sizes.tolist()])[:, None]
    else:
        if method == "score_first":
            key = -v[:, None]
        else:
            blend = (np.full(1, 0.5) if weights is None else weights)[:, None]
            cost = blend * (b / budget_b[:, None])[:, None] + (1 - blend) * (c / budget_c[:, None])[:, None]
            key = -np.divide(v[:, None], cost, out=np.full(cost.shape, np.inf), where=cost > 0)
        key[np.broadcast_to(pad[:, None], key.shape)] = np.nan  # last, after the group's own
        order = np.argsort(key, axis=2, kind="stable")
    of = np.repeat(rows, w)
    at = order.transpose(2, 0, 1).reshape(n, g * w)
    every_v, every_b, every_c = (x[of, at] for x in (v, b, c))
    most_b, most_c, least_b, least_c = (x[of] for x in (budget_b, budget_c, np.fmin.reduce(b, axis=1), np.fmin.reduce(c, axis=1)))
    used_b, used_c, total, off = (np.zeros(g * w) for _ in range(4))
    took = np.zeros((n, g * w), bool)
    for i in range(n):
        new_b, new_c = used_b + every_b[i], used_c + every_c[i]
        fits = (new_b <= most_b) & (new_c <= most_c)
        took[i] = fits
        np.copyto(used_b, new_b, where=fits)
        np.copyto(used_c, new_c, where=fits)
        # The sum of values with its error, as Python's sum has it.
        one = np.where(fits, every_v[i], 0.0)
        more = total + one
        off += np.where(np.abs(total) >= np.abs(one), (total - more) + one, (one - more) + total)
        total = more
        if i % 8 == 7 and ((used_b + least_b > most_b) | (used_c + least_c > most_c)).all():
            break
    total = np.where((off != 0) & np.isfinite(off), total + off, total).reshape(g, w)
    best = np.zeros(g, np.int64)
    if w > 1:  # a NaN counts as most
        best = np.array([x if x != x else round(x, 6) for x in total.ravel().tolist()]).reshape(g, w).argmax(1)
    lane, order = rows * w + best, order[rows, best]
    took = took[:, lane].T
    left = [np.fmax.reduce(np.where(took | pad, -np.inf, x[rows[:, None], order]), axis=1) for x in (b, c)]
    return best, total[rows, best], used_b[lane], used_c[lane], *left, took.sum(1), (order + np.zeros((g, 1), np.int64))[took], np.repeat(rows, took.sum(1))


def _alone(v: np.ndarray, b: np.ndarray, c: np.ndarray, budget_b: float, budget_c: float, method: str, weights: np.ndarray | None, seed: int) -> tuple:
    """Of one group the best weight's number, total, used bits and cycles, the largest bits and cycles left behind, and what was taken in order."""
    best = None
    for k, weight in enumerate([0.5] if weights is None else weights.tolist()):
        taken = walk(ordered(v, b, c, budget_b, budget_c, method if weights is None else "greedy_ratio", weight, seed), b, c, budget_b, budget_c)
        total = float(sum(v[taken].tolist()))
        rank = (np.isnan(total), 0.0 if np.isnan(total) else round(total, 6))
        if best is None or rank > best[0]:
            best = rank, k, total, taken
    _, k, total, taken = best
    left = np.ones(len(v), bool)
    left[taken] = False
    used = [float(np.cumsum(x[taken])[-1]) if taken else 0.0 for x in (b, c)]
    return k, total, *used, *(float(np.fmax.reduce(x[left])) if left.any() else -np.inf for x in (b, c)), np.array(taken, np.int64)


def _walked(v: np.ndarray, b: np.ndarray, c: np.ndarray, budget_b: np.ndarray, budget_c: np.ndarray, starts: np.ndarray, method: str, weights: np.ndarray | None, seed: int):
    """Plans of groups that lie one after another, by blocks of groups of like size: groups, what ``_alone`` gives of each, and rows taken."""
    sizes, w = np.diff(starts), 1 if weights is None else len(weights)
    by, i, single = np.argsort(sizes, kind="stable"), 0, []
    while i < len(by):
        j = i + 1
        while j < len(by) and (j + 1 - i) * w * sizes[by[j]] <= CELLS:
            j += 1
        own = by[i:j]
        if len(own) * w < LANES:
            single += own.tolist()
        else:
            n = sizes[own].max()
            real = np.arange(n) < sizes[own][:, None]
            at = (starts[own][:, None] + np.arange(n))[real]
            wide = [np.full(real.shape, np.nan) for _ in range(3)]
            for x, y in zip(wide, (v, b, c), strict=True):
                x[real] = y[at]
            with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
                *found, counts, places, of = _together(*wide, budget_b[own], budget_c[own], sizes[own], method, weights, seed)
            yield own, *found, counts, starts[own][of] + places
        i = j
    if single:
        each = [_alone(*(x[starts[k] : starts[k + 1]] for x in (v, b, c)), float(budget_b[k]), float(budget_c[k]), method, weights, seed) for k in single]
        yield np.array(single), *(np.array(x) for x in list(zip(*each, strict=True))[:-1]), np.array([len(x[-1]) for x in each]), np.concatenate([starts[k] + x[-1] for k, x in zip(single, each, strict=True)])


def greedy(items: DataFrame, keys: list[str], method: str) -> DataFrame:
    """One plan for each group of items (idx, v, b, c, budget_b, budget_c): a walk over numpy arrays, linear in what a
    group can reach.

    The sequential walk needs those candidates in order, so they are one task's numbers; groups run in parallel.
    """
    return greedy_arrow(items, keys, method).drop("best_weight")


def greedy_arrow(items: DataFrame, keys: list[str], method: str, seed: int = 0, weights: int = 21) -> DataFrame:
    """``greedy`` with the weight that a sweep found best; sums run in the order of the walk.

    A sweep walks every weight over the same candidates, and takes the first best one (to six digits, as sums of the
    same items in another order differ beyond).
    """
    return greedy_by_methods(items, keys, [method], seed, weights).drop("_walk")


def greedy_by_methods(items: DataFrame, keys: list[str], methods: list[str], seed: int = 0, weights: int = 21) -> DataFrame:
    """``greedy_arrow`` for each of ``methods`` (column ``_walk``), over one shuffled copy of the items where none can be cut.

    Tasks take whole groups in order and walk many small ones in step, so a group costs no call of its own.
    """
    with_workers(items.sparkSession)
    most = _most(items, keys) if set(methods) != {"random"} else None
    if most is not None:
        plans = [_planned(items if m == "random" else _cut(items, keys, m, most), keys, [m], seed, weights) for m in methods]
        every = plans[0]
        for p in plans[1:]:
            every = every.unionByName(p)
        sizes = items.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.count("*").alias("n_candidates"))
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
        every = every.drop("n_candidates").join(sizes, same)
    else:
        every = _planned(items, keys, methods, seed, weights)
    return every.select(*keys, "_walk", "total_value", "used_bits", "used_cycles", "selected", "n_candidates", "binding_constraint", "best_weight")


def _planned(some: DataFrame, keys: list[str], methods: list[str], seed: int, weights: int) -> DataFrame:
    key_schema = ", ".join(f"`{k}` {some.schema[k].dataType.simpleString()}" for k in keys)
    blends = np.array(np.linspace(0, 1, max(2, weights)).tolist())
    names = np.array(["neither", "bits", "cycles", "both"])

    def run(batches):
        for t, starts in _groups(batches, keys):
            if t.column("budget_b").null_count or t.column("budget_c").null_count:
                raise ValueError("budgets must not be null")
            v, b, c, budget_b, budget_c, idx = (t.column(k).to_numpy().astype(np.int64 if k == "idx" else float) for k in ("v", "b", "c", "budget_b", "budget_c", "idx"))
            budget_b, budget_c = budget_b[starts[:-1]], budget_c[starts[:-1]]
            for method in methods:
                sweep = method == "greedy_sweep"
                for own, best, total, used_b, used_c, left_b, left_c, counts, at in _walked(v, b, c, budget_b, budget_c, starts, method, blends if sweep else None, seed):
                    bound = names[(left_b > budget_b[own] - used_b + 1e-9) + 2 * (left_c > budget_c[own] - used_c + 1e-9)]
                    selected = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(idx[at]))
                    weight = pa.array(blends[best]) if sweep else pa.nulls(len(own), pa.float64())
                    columns = [pa.array(x) for x in (total, used_b, used_c)]
                    firsts = t.select(keys).take(pa.array(starts[own])).combine_chunks()
                    out = {k: firsts.column(k) for k in keys}
                    out |= {"_walk": [method] * len(own), "total_value": columns[0], "used_bits": columns[1], "used_cycles": columns[2], "selected": selected, "n_candidates": pa.array(np.diff(starts)[own], pa.int64()), "binding_constraint": bound.tolist(), "best_weight": weight}
                    yield from pa.table(out).combine_chunks().to_batches()

    dealt = some.select(*keys, "idx", "v", "b", "c", "budget_b", "budget_c").repartition(*keys).sortWithinPartitions(*keys, "idx")
    return dealt.mapInArrow(run, f"{key_schema}, _walk string, {_PLAN}")


def fractional_bound(items: DataFrame, keys: list[str]) -> DataFrame:
    """upper_bound: the smaller of the two single-budget fractional optima."""

    def one(cost: str, cap: str):
        rate = F.when(F.col(cost) > 0, F.col("v") / F.greatest(F.col(cost), F.lit(1e-12))).otherwise(F.lit(float("inf")))
        before = F.coalesce(F.sum(cost).over(W.partitionBy(*keys).orderBy(F.desc(f"_r_{cost}"), "idx").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
        share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(cap) - before) / F.col(cost)))
        free = F.when(before < F.col(cap), F.greatest(F.lit(0.0), F.col("v"))).otherwise(0.0)
        return rate, F.when(F.col(cost) > 0, share * F.col("v")).otherwise(free)

    (rb, gb), (rc, gc) = one("b", "budget_b"), one("c", "budget_c")
    rated = items.withColumn("_r_b", rb).withColumn("_r_c", rc)
    gained = rated.withColumn("_g_b", gb).withColumn("_g_c", gc)
    return gained.groupBy(*keys).agg(F.least(F.sum("_g_b"), F.sum("_g_c")).alias("upper_bound"))
