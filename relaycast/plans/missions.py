"""Windows, selection under budgets, replay, and the roll-ups over them."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import cost as C
from ..functions import vectors as V
from ..operators import occupancy as O
from ..operators import pca, prefilter
from ..operators import replay as R
from ..operators import selection as S
from ..operators import windows as N
from ..operators.numbering import numbered
from ..session import table, with_workers
from .registry import MISSION, longs, mission, query

LENGTH = 4
#: Anchored windows of the whole mission, and by user, as a recursive chain of first days.
CHAIN = f"""days AS (SELECT DISTINCT sol FROM mission), chain AS (
  SELECT CAST(0 AS BIGINT) AS window, min(sol) AS first_sol FROM days
  UNION ALL SELECT window + 1, (SELECT min(sol) FROM days WHERE sol >= first_sol + {LENGTH}) FROM chain WHERE (SELECT min(sol) FROM days WHERE sol >= first_sol + {LENGTH}) IS NOT NULL),
 win AS (SELECT "window", first_sol, (SELECT max(sol) FROM days WHERE sol < first_sol + {LENGTH}) AS last_sol FROM chain)"""
CHAIN = CHAIN.replace("AS window,", 'AS "window",').replace("SELECT window + 1", 'SELECT "window" + 1')


@query(f"""WITH RECURSIVE {MISSION}, {CHAIN} SELECT "window", first_sol, last_sol FROM win""")
def anchored_windows(spark, sf_dir):
    return N.anchored_windows(mission(spark, sf_dir), LENGTH).select("window", "first_sol", "last_sol")


@query(f"""WITH RECURSIVE {MISSION}, {CHAIN} SELECT "window", grp, count(*) AS n, sum(bits) AS bits FROM mission JOIN win ON sol BETWEEN first_sol AND last_sol GROUP BY 1, 2""")
def window_membership(spark, sf_dir):
    items = mission(spark, sf_dir)
    return N.with_windows(items, N.anchored_windows(items, LENGTH)).groupBy("window", "grp").agg(F.count("*").alias("n"), F.sum("bits").alias("bits"))


@query(f"""WITH RECURSIVE {MISSION}, u AS (SELECT DISTINCT user_id, sol FROM mission), s AS (SELECT user_id, CAST(0 AS BIGINT) AS w, min(sol) AS f FROM u GROUP BY user_id
  UNION ALL SELECT s.user_id, s.w + 1, (SELECT min(u.sol) FROM u WHERE u.user_id = s.user_id AND u.sol >= s.f + {LENGTH}) FROM s WHERE (SELECT min(u.sol) FROM u WHERE u.user_id = s.user_id AND u.sol >= s.f + {LENGTH}) IS NOT NULL)
  SELECT user_id, w AS "window", f AS first_sol FROM s""")
def anchored_windows_by_user(spark, sf_dir):
    return N.anchored_windows(mission(spark, sf_dir), LENGTH, ["user_id"]).select("user_id", "window", "first_sol")


@query(f"WITH {MISSION} SELECT idx, CAST(row_number() OVER (ORDER BY CASE WHEN grp <> 'excluded' THEN sol END NULLS LAST, class, idx) - 1 AS BIGINT) AS place FROM mission")
def mission_order_rownum(spark, sf_dir):
    """One mission-wide index; frames without a day (excluded ones are taken as undated) come last."""
    dated = mission(spark, sf_dir).select("idx", "class", F.when(F.col("grp") != "excluded", F.col("sol")).alias("sol"))
    return numbered(dated, F.col("sol").asc_nulls_last(), "class", "idx").select("idx", "place")


@query(f"""WITH RECURSIVE {MISSION}, {CHAIN}, t AS (SELECT sum(bits) AS bits, count(*) AS n FROM mission), k AS (SELECT count(*) AS k FROM win)
  SELECT k AS n_windows, bits / k * 0.25::DOUBLE AS bits_per_window, n / CAST(k AS DOUBLE) * 2599296 AS cycles_per_window, floor(bits / k * 0.25::DOUBLE / (bits / n)) AS frames_affordable,
   least(ceil(bits / k * 0.25::DOUBLE / (bits / n)) * 147456, n / CAST(k AS DOUBLE) * 2599296) AS reserve FROM t, k""")
def window_budget_derivation(spark, sf_dir):
    items = mission(spark, sf_dir)
    k = N.anchored_windows(items, LENGTH).agg(F.count("*").alias("k"))
    both = items.agg(F.sum("bits").alias("bits"), F.count("*").alias("n")).crossJoin(k)  # one row each
    bits, cycles = F.col("bits") / F.col("k") * 0.25, F.col("n") / F.col("k").cast("double") * 2_599_296
    return both.select(F.col("k").alias("n_windows"), bits.alias("bits_per_window"), cycles.alias("cycles_per_window"), F.floor(bits / (F.col("bits") / F.col("n"))).cast("double").alias("frames_affordable"), F.least(F.ceil(bits / (F.col("bits") / F.col("n"))) * 147_456.0, cycles).alias("reserve"))


@query(f"""WITH {MISSION}, d AS (SELECT sol, count(*) AS n, sum(score) AS s, sum(score*score) AS ss FROM mission GROUP BY sol),
  b AS (SELECT sol, coalesce(sum(n) OVER w, 0) AS n, coalesce(sum(s) OVER w, 0) AS s, coalesce(sum(ss) OVER w, 0) AS ss FROM d WINDOW w AS (ORDER BY sol ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
  SELECT idx, round(CASE WHEN n < 2 THEN 0 ELSE abs(score - s / n) / sqrt(greatest((ss - s * s / n) / (n - 1), 1e-12)) END, 5) AS z FROM mission JOIN b USING (sol)""")
def causal_prefilter_z(spark, sf_dir):
    items = mission(spark, sf_dir)
    before = N.causal_stats(items, "score")
    z = N.causal_z(F.col("score"), F.col("before_n"), F.col("before_mean"), F.col("before_m2"))
    return items.join(before, "sol").select("idx", F.round(z, 5).alias("z"))


ITEMS = f"""{MISSION}, cand AS (SELECT user_id, idx, score AS v, bits AS b, CAST(100 + idx % 7 AS DOUBLE) AS c, sum(bits) OVER (PARTITION BY user_id) * 0.25::DOUBLE AS budget_b, count(*) OVER (PARTITION BY user_id) * 40.0::DOUBLE AS budget_c FROM mission)"""


def candidates(spark, sf_dir):
    u = W.partitionBy("user_id")
    return mission(spark, sf_dir).select("user_id", "idx", F.col("score").alias("v"), F.col("bits").alias("b"), (100 + F.col("idx") % 7).cast("double").alias("c"), (F.sum("bits").over(u) * 0.25).alias("budget_b"), (F.count("*").over(u) * 40.0).alias("budget_c"))


def _walk(order: str) -> str:
    return f"""WITH RECURSIVE {ITEMS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {order}, idx) AS rn FROM cand),
  walk AS (SELECT user_id, CAST(0 AS BIGINT) AS rn, 0.0::DOUBLE AS tv, 0.0::DOUBLE AS ub, 0.0::DOUBLE AS uc, CAST(0 AS BIGINT) AS k FROM (SELECT DISTINCT user_id FROM cand)
   UNION ALL SELECT w.user_id, r.rn, CASE WHEN ub + b <= budget_b AND uc + c <= budget_c THEN tv + v ELSE tv END, CASE WHEN ub + b <= budget_b AND uc + c <= budget_c THEN ub + b ELSE ub END,
     CASE WHEN ub + b <= budget_b AND uc + c <= budget_c THEN uc + c ELSE uc END, CASE WHEN ub + b <= budget_b AND uc + c <= budget_c THEN k + 1 ELSE k END FROM walk w JOIN ranked r ON r.user_id = w.user_id AND r.rn = w.rn + 1)
  SELECT user_id, round(tv, 5) AS total_value, ub AS used_bits, uc AS used_cycles, k AS n_selected FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY rn DESC) AS last FROM walk) WHERE last = 1"""


def _plan(plan):
    return plan.select("user_id", F.round("total_value", 5).alias("total_value"), "used_bits", "used_cycles", F.size("selected").cast("long").alias("n_selected"))


@query(_walk("v DESC"))
def greedy_score_first(spark, sf_dir):
    return _plan(S.greedy(S.validated(candidates(spark, sf_dir)), ["user_id"], "score_first"))


@query(_walk("v / (0.5::DOUBLE * (b / budget_b) + 0.5::DOUBLE * (c / budget_c)) DESC"))
def greedy_ratio(spark, sf_dir):
    return _plan(S.greedy(candidates(spark, sf_dir), ["user_id"], "greedy_ratio"))


#: The walk of every weight, and the first best one.
SWEEP = f"""WITH RECURSIVE {ITEMS}, g AS (SELECT user_id, unnest(range(21)) AS step, budget_b, budget_c FROM (SELECT DISTINCT user_id, budget_b, budget_c FROM cand)),
  rated AS (SELECT g.step, g.step / 20.0::DOUBLE AS w, cand.* FROM g JOIN cand USING (user_id)),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id, step ORDER BY CASE WHEN w * (b / budget_b) + (1 - w) * (c / budget_c) > 0 THEN v / (w * (b / budget_b) + (1 - w) * (c / budget_c)) ELSE 'inf'::DOUBLE END DESC, idx) AS rn FROM rated),
  walk AS (SELECT user_id, step, budget_b, budget_c, CAST(0 AS BIGINT) AS rn, 0.0::DOUBLE AS tv, 0.0::DOUBLE AS ub, 0.0::DOUBLE AS uc, CAST(0 AS BIGINT) AS k, false AS took, 0.0::DOUBLE AS b, 0.0::DOUBLE AS c FROM g
   UNION ALL SELECT w.user_id, w.step, w.budget_b, w.budget_c, r.rn, CASE WHEN ub + r.b <= w.budget_b AND uc + r.c <= w.budget_c THEN tv + v ELSE tv END, CASE WHEN ub + r.b <= w.budget_b AND uc + r.c <= w.budget_c THEN ub + r.b ELSE ub END,
     CASE WHEN ub + r.b <= w.budget_b AND uc + r.c <= w.budget_c THEN uc + r.c ELSE uc END, CASE WHEN ub + r.b <= w.budget_b AND uc + r.c <= w.budget_c THEN k + 1 ELSE k END, ub + r.b <= w.budget_b AND uc + r.c <= w.budget_c, r.b, r.c
     FROM walk w JOIN ranked r ON r.user_id = w.user_id AND r.step = w.step AND r.rn = w.rn + 1),
  ends AS (SELECT user_id, step, max(tv) AS tv, max(ub) AS ub, max(uc) AS uc, max(k) AS k, max(b) FILTER (WHERE NOT took AND rn > 0) AS mb, max(c) FILTER (WHERE NOT took AND rn > 0) AS mc, any_value(budget_b) AS budget_b, any_value(budget_c) AS budget_c FROM walk GROUP BY user_id, step),
  best AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(tv, 6) DESC, step) AS r FROM ends)
  SELECT user_id, round(tv, 5) AS total_value, ub AS used_bits, uc AS used_cycles, k AS n_selected, round(step / 20.0::DOUBLE, 2) AS best_weight,
   CASE WHEN coalesce(mb > budget_b - ub + 1e-9, false) AND coalesce(mc > budget_c - uc + 1e-9, false) THEN 'both' WHEN coalesce(mb > budget_b - ub + 1e-9, false) THEN 'bits' WHEN coalesce(mc > budget_c - uc + 1e-9, false) THEN 'cycles' ELSE 'neither' END AS binding_constraint FROM best WHERE r = 1"""


@query(SWEEP)
def greedy_sweep_best(spark, sf_dir):
    plan = S.greedy_arrow(candidates(with_workers(spark), sf_dir), ["user_id"], "greedy_sweep")
    return plan.select("user_id", F.round("total_value", 5).alias("total_value"), "used_bits", "used_cycles", F.size("selected").cast("long").alias("n_selected"), F.round("best_weight", 2).alias("best_weight"), "binding_constraint")


@query()
def greedy_random(spark, sf_dir):
    return S.greedy_arrow(candidates(with_workers(spark), sf_dir), ["user_id"], "random").select("user_id", "used_bits", "used_cycles", F.size("selected").cast("long").alias("n_selected"))


BOUND = """bb AS (SELECT user_id, sum(greatest(0, least(1, (budget_b - p) / b)) * v) AS u FROM (SELECT *, coalesce(sum(b) OVER (PARTITION BY user_id ORDER BY v / greatest(b, 1e-12) DESC, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p FROM cand) GROUP BY user_id),
 bc AS (SELECT user_id, sum(greatest(0, least(1, (budget_c - p) / c)) * v) AS u FROM (SELECT *, coalesce(sum(c) OVER (PARTITION BY user_id ORDER BY v / greatest(c, 1e-12) DESC, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p FROM cand) GROUP BY user_id)"""


@query(f"WITH {ITEMS}, {BOUND} SELECT user_id, round(least(bb.u, bc.u), 8) AS upper_bound FROM bb JOIN bc USING (user_id)")
def fractional_upper_bound(spark, sf_dir):
    return S.fractional_bound(candidates(spark, sf_dir), ["user_id"]).select("user_id", F.round("upper_bound", 8).alias("upper_bound"))


@query(_walk("v DESC").replace("SELECT user_id, round(tv, 5) AS total_value, ub AS used_bits, uc AS used_cycles, k AS n_selected FROM", f", {BOUND}, plan AS (SELECT user_id, tv FROM") + ") SELECT user_id, round(CASE WHEN least(bb.u, bc.u) > 0 THEN greatest(0, 1 - tv / least(bb.u, bc.u)) END, 5) AS optimality_gap FROM plan JOIN bb USING (user_id) JOIN bc USING (user_id)")
def optimality_gap(spark, sf_dir):
    items = candidates(spark, sf_dir)
    both = S.greedy(items, ["user_id"], "score_first").join(S.fractional_bound(items, ["user_id"]), "user_id")
    return both.select("user_id", F.round(F.when(F.col("upper_bound") > 0, F.greatest(F.lit(0.0), 1 - F.col("total_value") / F.col("upper_bound"))), 5).alias("optimality_gap"))


@query(f"""WITH RECURSIVE {ITEMS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY v DESC, idx) AS rn FROM cand),
  walk AS (SELECT user_id, CAST(0 AS BIGINT) AS rn, 0.0::DOUBLE AS ub, 0.0::DOUBLE AS uc, false AS took, 0.0::DOUBLE AS b, 0.0::DOUBLE AS c FROM (SELECT DISTINCT user_id FROM cand)
   UNION ALL SELECT w.user_id, r.rn, CASE WHEN ub + r.b <= budget_b AND uc + r.c <= budget_c THEN ub + r.b ELSE ub END, CASE WHEN ub + r.b <= budget_b AND uc + r.c <= budget_c THEN uc + r.c ELSE uc END, ub + r.b <= budget_b AND uc + r.c <= budget_c, r.b, r.c FROM walk w JOIN ranked r ON r.user_id = w.user_id AND r.rn = w.rn + 1),
  e AS (SELECT user_id, max(ub) AS ub, max(uc) AS uc, max(b) FILTER (WHERE NOT took AND rn > 0) AS mb, max(c) FILTER (WHERE NOT took AND rn > 0) AS mc FROM walk GROUP BY user_id), g AS (SELECT user_id, max(budget_b) AS budget_b, max(budget_c) AS budget_c FROM cand GROUP BY user_id)
  SELECT user_id, CASE WHEN coalesce(mb > budget_b - ub + 1e-9, false) AND coalesce(mc > budget_c - uc + 1e-9, false) THEN 'both' WHEN coalesce(mb > budget_b - ub + 1e-9, false) THEN 'bits' WHEN coalesce(mc > budget_c - uc + 1e-9, false) THEN 'cycles' ELSE 'neither' END AS binding_constraint FROM e JOIN g USING (user_id)""")
def binding_constraint(spark, sf_dir):
    return S.greedy(candidates(spark, sf_dir), ["user_id"], "score_first").select("user_id", "binding_constraint")


def stats_mission(spark, sf_dir):
    return mission(with_workers(spark), sf_dir).select("idx", "sol", "grp", "bits", "score", F.array("score", F.col("bits") / 8).alias("stats"))


POLICY_BITS = 2000.0


@query(f"""WITH RECURSIVE {MISSION}, {CHAIN}, c AS (SELECT "window", idx, grp, bits, score AS sv, -(sol * 10000.0::DOUBLE + idx) AS fv, CASE WHEN grp = 'natural' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS ov FROM mission JOIN win ON sol BETWEEN first_sol AND last_sol),
 m AS (SELECT 'fifo' AS method, *, fv AS v FROM c UNION ALL SELECT 'score_first', *, sv FROM c UNION ALL SELECT 'greedy_ratio', *, sv / bits FROM c UNION ALL SELECT 'oracle', *, ov / bits FROM c),
 r AS (SELECT method, "window", idx, grp, bits, row_number() OVER (PARTITION BY method, "window" ORDER BY v DESC, idx) AS rn FROM m),
 walk AS (SELECT method, "window", CAST(0 AS BIGINT) AS rn, 0.0::DOUBLE AS ub, false AS took, '' AS grp, 0.0::DOUBLE AS bits FROM (SELECT DISTINCT method, "window" FROM r)
  UNION ALL SELECT w.method, w."window", r.rn, CASE WHEN ub + r.bits <= {POLICY_BITS}::DOUBLE THEN ub + r.bits ELSE ub END, ub + r.bits <= {POLICY_BITS}::DOUBLE, r.grp, r.bits FROM walk w JOIN r ON r.method = w.method AND r."window" = w."window" AND r.rn = w.rn + 1),
 t AS (SELECT method, count(*) FILTER (WHERE took) AS n_sent, count(*) FILTER (WHERE took AND grp = 'natural') AS n_natural, sum(CASE WHEN took AND grp = 'rover' THEN bits ELSE 0 END) AS rover_bits, sum(CASE WHEN took THEN bits ELSE 0 END) AS used FROM walk GROUP BY method),
 f AS (SELECT n_natural FROM t WHERE method = 'fifo'), a AS (SELECT count(*) AS n FROM mission WHERE grp = 'natural')
 SELECT method, n_sent, t.n_natural, round(t.n_natural / CAST(a.n AS DOUBLE), 9) AS science_yield, round(rover_bits / used, 9) AS wasted_bit_share, round(t.n_natural / CAST(f.n_natural AS DOUBLE), 6) AS against_fifo FROM t, f, a""")
def policy_comparison(spark, sf_dir):
    """What each policy sends of every window's arrivals under one bit budget, and how that compares with FIFO."""
    items = mission(spark, sf_dir)
    held = N.with_windows(items, N.anchored_windows(items, LENGTH))
    natural = F.col("grp") == "natural"
    values = F.array(
        *[F.struct(F.lit(m).alias("method"), v.alias("v")) for m, v in (("fifo", -(F.col("sol") * 10_000.0 + F.col("idx"))), ("score_first", F.col("score")), ("greedy_ratio", F.col("score") / F.col("bits")), ("oracle", natural.cast("double") / F.col("bits")))]
    )
    cand = held.select("window", "idx", "grp", F.col("bits").alias("b"), F.lit(0.0).alias("c"), F.lit(POLICY_BITS).alias("budget_b"), F.lit(1.0).alias("budget_c"), F.inline(values))
    plan = S.greedy(cand, ["method", "window"], "score_first").select("method", F.explode("selected").alias("idx"))
    sent = plan.join(items.select("idx", "grp", "bits"), "idx").groupBy("method").agg(F.count("*").alias("n_sent"), F.count_if(natural).alias("n_natural"), F.sum(F.when(F.col("grp") == "rover", F.col("bits")).otherwise(0.0)).alias("rover"), F.sum("bits").alias("used"))
    total = items.agg(F.count_if(natural).alias("n"))
    fifo = sent.filter("method = 'fifo'").select(F.col("n_natural").alias("fifo"))
    both = sent.crossJoin(F.broadcast(total)).crossJoin(F.broadcast(fifo))  # one row each
    return both.select("method", "n_sent", "n_natural", F.round(C.ratio(F.col("n_natural"), F.col("n")), 9).alias("science_yield"), F.round(C.ratio(F.col("rover"), F.col("used")), 9).alias("wasted_bit_share"), F.round(C.ratio(F.col("n_natural"), F.col("fifo"), None), 6).alias("against_fifo"))


BASE = R.Config(sols_per_window=LENGTH, max_age=10, compute_fraction=0.2, prefilter_cycles=2000.0)


@query()
def replay_window_log(spark, sf_dir):
    return R.run_all(stats_mission(spark, sf_dir), [(m, m, BASE) for m in R.POLICIES])


@query()
def replay_summary(spark, sf_dir):
    return R.run_all(stats_mission(spark, sf_dir), [(m, m, BASE) for m in R.POLICIES], log=False)


#: Hardware of the experiments: what one score costs on its own, on the fixed processor, and what that was sized for.
FIXED_COST, FIXED_SIZE = 28_286_976.0, 2_599_296.0


@query()
def replay_experiments(spark, sf_dir):
    """Baseline, fixed hardware, unlimited compute, online adaptation with and without feedback, and a bounded buffer, at three downlinks."""
    online = replace(BASE, adaptation="online", bootstrap_sols=8, refit_every=2)
    kinds = {
        "baseline": BASE,
        "fixed": replace(BASE, cycles_per_score=FIXED_COST, provisioned_cycles=FIXED_SIZE),
        "unlimited": replace(BASE, unlimited_compute=True),
        "online": online,
        "feedback": replace(online, ground_feedback=True),
        "buffer": replace(BASE, capacity=200),
    }
    runs = [(f"{k}-{m}-{d}", m, replace(c, downlink_fraction=d)) for k, c in kinds.items() for m in R.SCORE_BASED for d in (0.1, 0.25, 0.5)]
    return R.run_all(stats_mission(spark, sf_dir), runs, log=False)


@query()
def replay_by_user_group(spark, sf_dir):
    """A mission for each class of users: missions are dealt by key, so no task holds all of them."""
    items = stats_mission(spark, sf_dir).join(mission(spark, sf_dir).select("idx", (F.col("user_id") % 16).alias("tenant")), "idx")
    return R.run_all(items, [(m, m, BASE) for m in R.POLICIES], log=False, by=["tenant"])


def vector_mission(spark, sf_dir):
    """The driver's embeddings as frames of a mission, ten a day; one label is of interest, one is of the craft itself."""
    k = F.col("label")
    return table(with_workers(spark), sf_dir, "embeddings").select(
        F.col("vec_id").cast("long").alias("idx"), F.floor(F.col("vec_id") / 10).cast("long").alias("sol"), F.when(k == 0, "natural").when(k == 1, "rover").otherwise("typical").alias("grp"),
        (F.size("embedding") * 8).cast("double").alias("bits"), V.doubles(F.col("embedding")).alias("features"),
    )


@query()
def replay_refitted_components(spark, sf_dir):
    """Frozen and refitted principal components behind either prefilter, at three downlinks; the runs of a lane share refits."""
    frames = vector_mission(spark, sf_dir)
    model = pca.fit(frames.filter("grp = 'typical'"), "features", 8)
    scored = frames.join(pca.residual_scores(frames, "features", model, "idx").select("idx", F.col("recon_l2").alias("score")), "idx")
    found = []
    for mode in ("variance", "lowrank"):
        cheap = prefilter.build(mode, "features", len(model.mean), 4, model)
        base = replace(BASE, sols_per_window=10, max_age=40, cycles_per_score=5000.0, compute_fraction=0.5, compress_cycles=100.0, prefilter_cycles=float(cheap.flops))
        kinds = {"frozen": base, "online": replace(base, adaptation="online", bootstrap_sols=10, refit_every=2)}
        runs = [(f"{cheap.name}-{k}-{m}-{d}", m, replace(c, downlink_fraction=d)) for k, c in kinds.items() for m in R.SCORE_BASED for d in (0.1, 0.25, 0.5)]
        found.append(R.run_all(cheap.with_stats(scored), runs, log=False, fit=R.principal(8)))
    return found[0].unionByName(found[1])


@query(f"""WITH RECURSIVE {MISSION}, {CHAIN}, w AS (SELECT "window", count(*) FILTER (WHERE grp = 'natural' AND score > 20) AS sent, count(*) FILTER (WHERE grp = 'natural') AS avail, sum(CASE WHEN grp = 'rover' AND score > 20 THEN bits ELSE 0 END) AS rover, sum(CASE WHEN score > 20 THEN bits ELSE 0 END) AS used FROM mission JOIN win ON sol BETWEEN first_sol AND last_sol GROUP BY 1)
 SELECT "window", CAST(sum(sent) OVER o AS BIGINT) AS cum_sent, CAST(sum(avail) OVER o AS BIGINT) AS cum_available, round(CASE WHEN sum(avail) OVER o > 0 THEN sum(sent) OVER o / CAST(sum(avail) OVER o AS DOUBLE) ELSE 0 END, 9) AS cum_yield, round(CASE WHEN sum(used) OVER o > 0 THEN sum(rover) OVER o / sum(used) OVER o ELSE 0 END, 9) AS cum_wasted FROM w WINDOW o AS (ORDER BY "window")""")
def cumulative_yield_curve(spark, sf_dir):
    items = mission(spark, sf_dir)
    got, natural, rover = F.col("score") > 20, F.col("grp") == "natural", F.col("grp") == "rover"
    by = N.with_windows(items, N.anchored_windows(items, LENGTH)).groupBy("window").agg(F.count_if(natural & got).alias("sent"), F.count_if(natural).alias("available"), F.sum(F.when(rover & got, F.col("bits")).otherwise(0.0)).alias("rover"), F.sum(F.when(got, F.col("bits")).otherwise(0.0)).alias("used"))
    run = N.running_total(by.withColumn("mission", F.lit(0)), ["mission"], "window", ["sent", "available", "rover", "used"])  # one row a window
    return longs(run.select("window", "cum_sent", "cum_available", F.round(C.ratio(F.col("cum_sent"), F.col("cum_available")), 9).alias("cum_yield"), F.round(C.ratio(F.col("cum_rover"), F.col("cum_used")), 9).alias("cum_wasted")), "cum_sent", "cum_available")


@query(f"WITH {MISSION} SELECT user_id, count(*) FILTER (WHERE greatest(0, 20 - sol) > 10) AS n_expired, count(*) FILTER (WHERE greatest(0, 20 - sol) <= 10) AS n_held FROM mission WHERE sol <= 20 GROUP BY user_id")
def expiry_predicate(spark, sf_dir):
    age = F.greatest(F.lit(0), 20 - F.col("sol"))
    return mission(spark, sf_dir).filter("sol <= 20").groupBy("user_id").agg(F.count_if(age > 10).alias("n_expired"), F.count_if(age <= 10).alias("n_held"))


@query(f"WITH {MISSION} SELECT user_id, idx FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY sol, idx) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM mission) WHERE r <= n - 60")
def capacity_eviction(spark, sf_dir):
    u = W.partitionBy("user_id")
    return mission(spark, sf_dir).withColumn("r", F.row_number().over(u.orderBy("sol", "idx"))).withColumn("n", F.count("*").over(u)).filter("r <= n - 60").select("user_id", "idx")


@query(f"WITH {MISSION} SELECT sol, idx FROM (SELECT *, row_number() OVER (PARTITION BY sol ORDER BY score DESC, idx) AS r FROM mission) WHERE r <= 3 + sol % 5")
def triage_affordable(spark, sf_dir):
    w = W.partitionBy("sol").orderBy(F.desc("score"), "idx")
    return mission(spark, sf_dir).withColumn("r", F.row_number().over(w)).filter(F.col("r") <= 3 + F.col("sol") % 5).select("sol", "idx")


@query(f"WITH {MISSION} SELECT m.idx FROM mission m WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = m.idx) ")
def needs_scoring_anti(spark, sf_dir):
    return mission(spark, sf_dir).join(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("idx")), "idx", "left_anti").select("idx")


@query(f"WITH {MISSION} SELECT m.idx, l.quality FROM mission m LEFT JOIN labels l ON l.doc_id = m.idx WHERE l.quality IS NOT NULL")
def score_cache_eligible(spark, sf_dir):
    return mission(spark, sf_dir).join(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("idx"), "quality"), "idx", "left").filter("quality is not null").select("idx", "quality")


@query(f"WITH {MISSION} SELECT idx FROM mission m WHERE grp <> 'natural' AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = m.idx) ORDER BY idx DESC LIMIT 4000")
def refit_pool_tail(spark, sf_dir):
    seen = mission(spark, sf_dir).filter("grp <> 'natural'")
    return seen.join(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("idx")), "idx", "left_anti").orderBy(F.desc("idx")).limit(4000).select("idx")


@query(f"""WITH RECURSIVE {MISSION}, {CHAIN}, w AS (SELECT "window", count(*) FILTER (WHERE score > 60) AS num, count(*) AS den FROM mission JOIN win ON sol BETWEEN first_sol AND last_sol GROUP BY 1), n AS (SELECT count(*) AS n FROM w)
 SELECT round(sum(CASE WHEN "window" < 5 THEN num ELSE 0 END) / CAST(greatest(1, sum(CASE WHEN "window" < 5 THEN den ELSE 0 END)) AS DOUBLE), 9) AS early, round(sum(CASE WHEN "window" >= n - 5 THEN num ELSE 0 END) / CAST(greatest(1, sum(CASE WHEN "window" >= n - 5 THEN den ELSE 0 END)) AS DOUBLE), 9) AS late FROM w, n""")
def early_late_ratio(spark, sf_dir):
    items = mission(spark, sf_dir)
    by = N.with_windows(items, N.anchored_windows(items, LENGTH)).groupBy("window").agg(F.count_if(F.col("score") > 60).alias("num"), F.count("*").alias("den"))
    all_ = by.crossJoin(by.agg(F.count("*").alias("n")))  # one row
    share = lambda p: F.round(F.sum(F.when(p, F.col("num")).otherwise(0)) / F.greatest(F.lit(1), F.sum(F.when(p, F.col("den")).otherwise(0))).cast("double"), 9)
    return all_.agg(share(F.col("window") < 5).alias("early"), share(F.col("window") >= F.col("n") - 5).alias("late"))


DAYS = f"{MISSION}, d AS (SELECT sol, count(*) FILTER (WHERE grp = 'natural' AND score > 150) AS lost, count(*) AS held FROM mission GROUP BY sol)"


def days(spark, sf_dir):
    return mission(spark, sf_dir).groupBy("sol").agg(F.count_if((F.col("grp") == "natural") & (F.col("score") > 150)).alias("lost"), F.count("*").alias("held"))


@query(f"WITH {DAYS} SELECT sol, lost FROM (SELECT * FROM d ORDER BY lost DESC, sol LIMIT 3) WHERE lost > 0")
def top3_windows(spark, sf_dir):
    return days(spark, sf_dir).orderBy(F.desc("lost"), "sol").limit(3).filter("lost > 0").select("sol", "lost")


@query(f"WITH {DAYS} SELECT sol, held FROM d ORDER BY held DESC, sol LIMIT 1")
def most_loaded(spark, sf_dir):
    return days(spark, sf_dir).orderBy(F.desc("held"), "sol").limit(1).select("sol", "held")


@query(f"WITH {DAYS} SELECT min(sol) AS first_lossy FROM d WHERE lost > 0")
def first_window_over(spark, sf_dir):
    return days(spark, sf_dir).agg(F.min(F.when(F.col("lost") > 0, F.col("sol"))).alias("first_lossy"))


@query("""WITH h(hardware, rate) AS (VALUES ('rad750', 3.0::DOUBLE), ('myriad', 0.25::DOUBLE), ('snapdragon', 0.1::DOUBLE)), a AS (SELECT DISTINCT l_returnflag AS adaptation FROM lineitem), p AS (SELECT DISTINCT l_linenumber AS policy FROM lineitem),
 r AS (SELECT l_returnflag AS adaptation, l_linenumber AS policy, count(*) AS n, sum(l_quantity) AS work FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1, 2)
 SELECT hardware || '|' || a.adaptation || '|' || p.policy AS key, coalesce(n, 0) AS n_runs, round(coalesce(work, 0) * rate, 3) AS cycles FROM h CROSS JOIN a CROSS JOIN p LEFT JOIN r ON r.adaptation = a.adaptation AND r.policy = p.policy""")
def grid_crossjoin_cells(spark, sf_dir):
    """Every cell of the axes that run records have, with what ran in it; a cell without runs is there too."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("adaptation"), F.col("l_linenumber").alias("policy"), "l_linestatus", "l_quantity")
    axes = rows.select("adaptation").distinct().crossJoin(rows.select("policy").distinct())  # two short axes
    ran = rows.filter("l_linestatus = 'O'").groupBy("adaptation", "policy").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("work"))
    cells = axes.join(ran, ["adaptation", "policy"], "left").select("*", F.inline(F.array(*[F.struct(F.lit(k).alias("hardware"), F.lit(v).alias("rate")) for k, v in C.CYCLES_PER_FLOP.items()])))
    return cells.select(F.concat_ws("|", "hardware", "adaptation", "policy").alias("key"), F.coalesce("n", F.lit(0)).alias("n_runs"), F.round(F.coalesce("work", F.lit(0.0)) * F.col("rate"), 3).alias("cycles"))


@query("""WITH f AS (SELECT o_custkey, sum(o_totalprice) AS y FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), n AS (SELECT o_custkey, sum(o_totalprice) AS y FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
 SELECT f.o_custkey AS run, round(f.y, 2) AS frozen, round(n.y, 2) AS online, round(n.y - f.y, 2) AS gain FROM f LEFT JOIN n USING (o_custkey)""")
def frozen_vs_online_left(spark, sf_dir):
    by = table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.sum("o_totalprice").alias("y"))
    frozen, online = (by.filter(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("run"), F.col("y").alias(n)) for s, n in (("F", "frozen"), ("O", "online")))
    return frozen.join(online, "run", "left").select("run", F.round("frozen", 2).alias("frozen"), F.round("online", 2).alias("online"), F.round(F.col("online") - F.col("frozen"), 2).alias("gain"))


@query("""WITH a AS (SELECT o_custkey, max(o_totalprice) AS y FROM orders GROUP BY 1) SELECT c_custkey AS run, round(y / c_acctbal, 6) AS share FROM a JOIN customer ON c_custkey = o_custkey WHERE c_acctbal > 0""")
def achieved_vs_bound_inner(spark, sf_dir):
    a = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("run")).agg(F.max("o_totalprice").alias("y"))
    b = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("run"), "c_acctbal")
    return a.join(b, "run").select("run", F.round(F.col("y") / F.col("c_acctbal"), 6).alias("share"))


@query(f"""WITH {MISSION}, s AS (SELECT sol, user_id % 7 AS run, grp, count(*) AS n FROM mission GROUP BY 1, 2, 3), a AS (SELECT sol, run, n FROM s WHERE grp = 'natural'), b AS (SELECT sol, run, n FROM s WHERE grp = 'rover'), c AS (SELECT sol, run, n FROM s WHERE grp = 'typical')
 SELECT sol, run, a.n AS "natural", b.n AS rover, c.n AS typical FROM a FULL JOIN b USING (sol, run) FULL JOIN c USING (sol, run)""")
def series_full_outer_pivot(spark, sf_dir):
    by = mission(spark, sf_dir).groupBy("sol", (F.col("user_id") % 7).alias("run"), "grp").agg(F.count("*").alias("n"))
    one, two, three = (by.filter(F.col("grp") == g).select("sol", "run", F.col("n").alias(g)) for g in ("natural", "rover", "typical"))
    return one.join(two, ["sol", "run"], "full_outer").join(three, ["sol", "run"], "full_outer")


@query(f"""WITH {MISSION} SELECT user_id, count(*) FILTER (WHERE sol <= 15 AND NOT (score > 30 AND sol + CAST(floor(score / 30) AS BIGINT) <= 15)) AS n_held FROM mission GROUP BY user_id""")
def buffer_at_window(spark, sf_dir):
    items = mission(spark, sf_dir)
    gone = items.filter((F.col("score") > 30) & (F.col("sol") + F.floor(F.col("score") / 30) <= 15)).select("idx")
    held = items.filter("sol <= 15").join(gone, "idx", "left_anti").groupBy("user_id").agg(F.count("*").alias("n"))
    return items.select("user_id").distinct().join(held, "user_id", "left").select("user_id", F.coalesce("n", F.lit(0)).alias("n_held"))


@query(f"""WITH {MISSION}, users AS (SELECT DISTINCT user_id FROM mission), days AS (SELECT unnest(range((SELECT min(sol) FROM mission), (SELECT max(sol) + 1 FROM mission))) AS day),
 b AS (SELECT user_id, sol, bits, grp, CASE WHEN score > 30 THEN sol + CAST(floor(score / 30) AS BIGINT) END AS leave FROM mission)
 SELECT u.user_id, day, count(b.sol) AS n_held, count(b.sol) FILTER (WHERE grp = 'natural') AS n_natural, coalesce(sum(bits), 0) AS bits
 FROM users u CROSS JOIN days LEFT JOIN b ON b.user_id = u.user_id AND b.sol <= day AND (leave IS NULL OR leave > day) GROUP BY ALL""")
def buffer_at_every_window(spark, sf_dir):
    """What each user's buffer holds on every day, by a sweep over arrivals and departures."""
    items = mission(spark, sf_dir).withColumn("leave", F.when(F.col("score") > 30, F.col("sol") + F.floor(F.col("score") / 30)))
    days = items.agg(F.min("sol").alias("a"), F.max("sol").alias("b"))
    every = items.select("user_id").distinct().crossJoin(F.broadcast(days)).select("user_id", F.explode(F.sequence("a", "b")).alias("at"))  # one row
    held = O.occupancy(items, ["user_id"], "sol", "leave", {"n_held": "1", "n_natural": "if(grp = 'natural', 1, 0)", "bits": "bits"}, every, ranges=4)
    return longs(held.withColumnRenamed("at", "day"), "n_held", "n_natural")


@query(f"""WITH {MISSION}, s AS (SELECT DISTINCT user_id, sol FROM mission WHERE score > 40), g AS (SELECT user_id, sol, sol - row_number() OVER (PARTITION BY user_id ORDER BY sol) AS g FROM s), r AS (SELECT user_id, min(sol) AS a, max(sol) AS b FROM g GROUP BY user_id, g),
 k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY a) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM r), d AS (SELECT user_id, count(DISTINCT sol) AS total FROM mission GROUP BY 1),
 t AS (SELECT user_id, CAST(sum(b - a + 1) AS BIGINT) AS n_windows, max(n) AS n, string_agg(CASE WHEN a = b THEN CAST(a AS VARCHAR) WHEN b - a = 1 THEN a || ', ' || b ELSE a || '–' || b END, ', ' ORDER BY a) FILTER (WHERE k <= 8) AS shown FROM k GROUP BY user_id)
 SELECT d.user_id, coalesce(n_windows, 0) AS n_windows, CASE WHEN n_windows IS NULL THEN 'none' WHEN n_windows = total THEN 'all ' || total || ' windows'
  ELSE n_windows || ' of ' || total || ' windows: ' || shown || CASE WHEN n > 8 THEN ', … (+' || (n - 8) || ' more runs)' ELSE '' END END AS text FROM d LEFT JOIN t ON t.user_id = d.user_id""")
def window_set_islands(spark, sf_dir):
    items = mission(spark, sf_dir)
    runs = N.islands(items.filter("score > 40"), ["user_id"], "sol")
    return N.format_islands(runs, ["user_id"], items.groupBy("user_id").agg(F.countDistinct("sol").alias("total")))


@query(f"""WITH {MISSION}, r AS (SELECT user_id, count(*) AS windows, sum(bits) AS bits_used, count(*) FILTER (WHERE grp = 'natural') AS n_natural, count(*) FILTER (WHERE grp = 'natural' AND sol <= 15) AS n_available, arg_max(score, idx) AS last_score, avg(CASE WHEN score > 50 THEN score END) AS recall FROM mission GROUP BY user_id)
 SELECT user_id, windows, bits_used, n_natural, n_available, last_score, round(recall, 6) AS recall, CASE WHEN n_natural > 0 THEN 2 * n_available < n_natural ELSE n_available < 20 END AS provisional FROM r""")
def run_rollup(spark, sf_dir):
    natural = F.col("grp") == "natural"
    got = mission(spark, sf_dir).groupBy("user_id").agg(
        F.count("*").alias("windows"), F.sum("bits").alias("bits_used"), F.count_if(natural).alias("n_natural"), F.count_if(natural & (F.col("sol") <= 15)).alias("n_available"),
        F.max_by("score", "idx").alias("last_score"), F.round(F.avg(F.when(F.col("score") > 50, F.col("score"))), 6).alias("recall"),
    )
    return got.withColumn("provisional", C.provisional(F.col("n_available"), F.col("n_natural")))


@query(f"""WITH {MISSION} SELECT count(DISTINCT CASE WHEN grp = 'natural' THEN idx END) AS n_ever_natural, count(DISTINCT CASE WHEN grp = 'natural' AND score > 12 THEN idx END) AS n_scored_natural,
  count(DISTINCT CASE WHEN grp = 'natural' AND score > 12 THEN idx END) / CAST(count(DISTINCT CASE WHEN grp = 'natural' THEN idx END) AS DOUBLE) AS recall FROM mission""")
def distinct_recall(spark, sf_dir):
    natural = F.col("grp") == "natural"
    got = mission(spark, sf_dir).agg(F.countDistinct(F.when(natural, F.col("idx"))).alias("n_ever_natural"), F.countDistinct(F.when(natural & (F.col("score") > 12), F.col("idx"))).alias("n_scored_natural"))
    return got.withColumn("recall", C.ratio(F.col("n_scored_natural"), F.col("n_ever_natural"), 1.0))
