"""Replays against an independent loop over plain frames, refits shared or not, prefilters, the metric bundle."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from relaycast.operators import pca, prefilter, ranking, replay, windows

CFG = replay.Config(sols_per_window=3, max_age=5, downlink_fraction=0.3, compute_fraction=0.4, cycles_per_score=1000.0, compress_cycles=10.0, prefilter_cycles=1.0, bootstrap_sols=4, refit_every=2, refit_max=30)
ONLINE = replace(CFG, adaptation="online")


def rows(n=90, seed=3, d=6):
    rng = np.random.default_rng(seed)
    kind = rng.choice(["natural", "rover", "typical", "typical"], n)
    x = rng.standard_normal((n, d)) @ np.diag([5, 3, 1, 1, 1, 1.0]) + (kind == "natural")[:, None] * 3
    days = np.sort(rng.integers(0, 24, n))
    days[days > 18] += 9  # a gap
    stats = np.stack([x.var(1), np.abs(x).sum(1)], 1)
    return [{"idx": i, "sol": int(days[i]), "grp": str(kind[i]), "bits": float(rng.integers(3, 9) * 100), "stats": stats[i].tolist(), "score": float(np.linalg.norm(x[i])), "features": x[i].tolist()} for i in range(n)]


def by_hand(frames, method, cfg):
    """What each window sends and loses: one frame at a time, no masks, no shared helpers."""
    windows, left = [], sorted(frames, key=lambda r: (r["sol"], r["idx"]))
    while left:
        first = left[0]["sol"]
        windows.append([r for r in left if r["sol"] < first + cfg.sols_per_window])
        left = [r for r in left if r["sol"] >= first + cfg.sols_per_window]
    all_bits = sum(r["bits"] for r in frames)
    bits = all_bits / len(windows) * cfg.downlink_fraction
    cycles = len(frames) / len(windows) * cfg.cycles_per_score * cfg.compute_fraction
    reserve = min(np.ceil(bits / (all_bits / len(frames))) * cfg.compress_cycles, cycles)
    needs, buffer, cache, cheap, seen, out = method in ("score_first", "greedy_ratio"), [], {}, {}, [], []
    pool, booted, history = None, False, []
    for w, new in enumerate(windows):
        now = max(r["sol"] for r in new)
        buffer, seen = buffer + new, seen + new
        gone = [r for r in buffer if now - r["sol"] > cfg.max_age]
        buffer = [r for r in buffer if now - r["sol"] <= cfg.max_age]
        if cfg.capacity is not None and len(buffer) > cfg.capacity:
            gone += buffer[: len(buffer) - cfg.capacity]
            buffer = buffer[len(buffer) - cfg.capacity :]
        if cfg.adaptation == "online" and needs and ((not booted and now >= cfg.bootstrap_sols) or (booted and w % cfg.refit_every == 0)):
            taken = seen[-cfg.refit_max :]
            booted, cache = True, {}
            if len(taken) >= cfg.refit_least:
                pool = np.array([r["features"] for r in taken])
        fresh = [r for r in buffer if r["idx"] not in cheap]
        past = np.array(history)
        for r in fresh:
            cheap[r["idx"]] = 0.0 if len(past) < 2 else sum(abs(v - m) / max(s, 1e-6) for v, m, s in zip(r["stats"], past.mean(0), past.std(0, ddof=1), strict=True))
        history += [r["stats"] for r in fresh]
        budget = cycles - reserve - len(fresh) * cfg.prefilter_cycles
        eligible = buffer
        if needs:
            waiting = sorted((r for r in buffer if r["idx"] not in cache), key=lambda r: (-cheap[r["idx"]], r["idx"]))
            for r in waiting[: int(max(0, budget) // cfg.cycles_per_score)]:
                if pool is None:
                    cache[r["idx"]] = r["score"]
                else:
                    c = np.array(r["features"]) - pool.mean(0)
                    axes = np.linalg.svd(pool - pool.mean(0), full_matrices=False)[2][:2]
                    cache[r["idx"]] = float(np.linalg.norm(c - axes.T @ (axes @ c)))
                budget -= cfg.cycles_per_score
            eligible = [r for r in buffer if r["idx"] in cache]
        allowance = max(reserve + max(budget, 0), cfg.compress_cycles)

        def rank(r):
            ratio = lambda v: v / max(r["bits"] / bits + cfg.compress_cycles / allowance, 1e-12)
            return {"fifo": lambda: (r["sol"], r["idx"]), "score_first": lambda: (-cache[r["idx"]], r["idx"]), "greedy_ratio": lambda: (-ratio(cache[r["idx"]]), r["idx"]), "oracle": lambda: (-ratio(float(r["grp"] == "natural")), r["idx"])}[method]()

        sent, b, c = [], 0.0, 0.0
        for r in sorted(eligible, key=rank):
            if b + r["bits"] <= bits and c + cfg.compress_cycles <= allowance:
                sent, b, c = [*sent, r["idx"]], b + r["bits"], c + cfg.compress_cycles
        buffer = [r for r in buffer if r["idx"] not in sent]
        cache = {k: v for k, v in cache.items() if k not in sent}
        out.append((w, sorted(sent), sorted(r["idx"] for r in gone), round(b, 6)))
    return out


def table_of(spark, found):
    return spark.createDataFrame(found, "idx long, sol long, grp string, bits double, stats array<double>, score double, features array<double>")


@pytest.mark.parametrize("cfg", [CFG, replace(CFG, capacity=12), ONLINE, replace(ONLINE, downlink_fraction=0.6)], ids=["frozen", "buffer", "online", "wide"])
def test_replay_equals_a_loop(spark, cfg):
    methods = ["fifo", "score_first", "greedy_ratio", *(["oracle"] if cfg.capacity else [])]
    found = rows()
    got = replay.run_all(table_of(spark, found), [(m, m, cfg) for m in methods], fit=replay.principal(2)).collect()
    for m in methods:
        mine = sorted((r.window, sorted(r.selected_indices), sorted(r.lost_indices), round(r.bits_used, 6)) for r in got if r.run == m)
        assert mine == by_hand(found, m, cfg)


def test_missions_by_key_and_shared_refits_change_nothing(spark):
    runs = [(f"{m}-{d}", m, replace(ONLINE, downlink_fraction=d)) for m in replay.POLICIES for d in (0.2, 0.5)]
    parts = {k: rows(60, k) for k in (1, 2)}
    both = table_of(spark, parts[1]).withColumn("mission", F.lit(1)).unionByName(table_of(spark, parts[2]).withColumn("mission", F.lit(2)))
    got = {(r.mission, r.run, r.window): tuple(r.selected_indices) for r in replay.run_all(both, runs, by=["mission"], fit=replay.principal(2)).collect()}
    for k, found in parts.items():
        alone = replay.run_all(table_of(spark, found), runs, fit=replay.principal(2), share=False).collect()
        assert {(k, r.run, r.window): tuple(r.selected_indices) for r in alone} == {x: v for x, v in got.items() if x[0] == k}


def test_refits_are_made_once_for_all_budgets():
    found = rows()
    of = lambda c: np.array([r[c] for r in found])
    f = replay.Frames(of("idx"), of("sol"), of("grp").astype(object), of("bits"), of("stats"), of("score"), of("features"))
    made: list[int] = []

    def counted(pool):
        made.append(len(pool))
        return replay.principal(2)(f)(pool)

    memo: dict = {}
    for d in (0.1, 0.3, 0.9):
        _, summary = replay.replay(f, "score_first", replace(ONLINE, downlink_fraction=d), counted, memo)
    assert len(made) == len(memo) == summary["n_refits"] > 1
    with pytest.raises(ValueError):
        replay.principal(2)(replace(f, features=None))


def test_runs_that_never_refit_get_no_features(spark):
    def fit(f):
        assert f.features is not None
        return replay.nearest_to_mean(f)

    def never(f):
        raise AssertionError("no run refits")

    frames, frozen = table_of(spark, rows()), [("a", "score_first", CFG), ("b", "fifo", CFG)]
    want = {r.run: r for r in replay.run_all(frames, [*frozen, ("c", "score_first", ONLINE)], log=False, fit=fit).collect()}
    assert want["c"].n_refits > 0
    assert {r.run: r for r in replay.run_all(frames, frozen, log=False, fit=never).collect()} == {k: want[k] for k in "ab"}


@pytest.mark.parametrize("most", [1, 3, 50])
def test_the_last_frames_not_fed_back(most):
    fed = np.arange(40) % 7 > 0
    assert replay._last_unfed(list(range(40)), fed, most) == [i for i in range(40) if not fed[i]][-most:]


def test_prefilters(spark):
    df = table_of(spark, rows()).drop("stats")
    x = np.array([r["features"] for r in rows()])
    model = pca.fit(df, "features", 4)
    cheap = prefilter.build("lowrank", "features", 6, 2, model, 2)
    got = np.array([r.stats for r in cheap.with_stats(df).orderBy("idx").collect()])
    c = x - x.mean(0)
    p = c @ model.components[:2].T
    assert cheap.name == "lowrank(k=2)" and np.allclose(got[:, 0], np.linalg.norm(c - p @ model.components[:2], axis=1)) and np.allclose(got[:, 1], np.abs(p).sum(1))
    plain = prefilter.build("lowrank", "features", 6, 2)
    got = np.array([r.stats for r in plain.with_stats(df).orderBy("idx").collect()])
    assert plain.name == "variance (lowrank unavailable)" and plain.flops == 30
    assert np.allclose(got, np.stack([x.var(1), x.reshape(-1, 3, 2).mean(1).var(1)], 1))
    assert cheap.with_stats(df.limit(0)).count() == 0
    total, share = pca.explained(df, "features", pca.fit(df, "features", 6))
    assert np.isclose(total, (c * c).sum()) and np.isclose(share.sum(), 1)
    with pytest.raises(ValueError):
        prefilter.build("none", "features", 6, 2)


def test_metric_bundle(spark):
    df = spark.createDataFrame([(0, 1, 3.0), (1, 0, 3.0), (2, 0, 1.0), (3, 1, 2.0)], "idx long, y int, s double")
    r = ranking.metric_bundle(df, [2, 0, 1, 50]).first()
    assert (r.n_typical, r.n_novel, r.novel_rate) == (2, 2, 0.5)
    assert r.precision_at_k == {1: 0.0, 2: 0.5, 50: 0.5} and r.recall_at_k == {1: 0.0, 2: 0.5, 50: 1.0}
    assert r.roc_auc == 0.625 and np.isclose(r.average_precision, (1 / 2 + 2 / 3) / 2)


def test_causal_statistics_of_large_values(spark):
    rng = np.random.default_rng(5)
    days, values = rng.integers(0, 9, 200), 1e9 + rng.standard_normal(200)
    got = windows.causal_stats(spark.createDataFrame(list(zip(days.tolist(), values.tolist(), strict=True)), "sol long, v double"), "v").collect()
    for r in got:
        past = values[days < r.sol]
        assert r.before_n == len(past)
        if len(past):
            assert np.isclose(r.before_mean, past.mean(), rtol=1e-14) and np.isclose(r.before_m2, ((past - past.mean()) ** 2).sum(), rtol=1e-6)


def test_auc_of_classes_against_one_base(spark):
    rng = np.random.default_rng(6)
    base, own = rng.integers(0, 30, 300).astype(float), [(k, float(s)) for k in "abc" for s in rng.integers(0, 40, 50)]
    got = ranking.auc_against(spark.createDataFrame([(x,) for x in base.tolist()], "s double"), spark.createDataFrame(own, "k string, s double"), "k").collect()
    for r in got:
        mine = np.array([s for k, s in own if k == r.k])[:, None]
        assert r.n == 50 and np.isclose(r.roc_auc, ((mine > base).mean() + (mine == base).mean() / 2))
