"""Selection with what can't be reached cut away, against whole walks."""

from __future__ import annotations

import random

import numpy as np
import pytest

from relaycast.operators import selection

SCHEMA = "g string, idx long, v double, b double, c double, budget_b double, budget_c double"


def whole(rows, method):
    """The plan of a walk over all of one group's items."""
    rows = sorted(rows, key=lambda r: r[1])
    v, b, c = (np.array([r[k] for r in rows]) for k in (2, 3, 4))
    weights = np.linspace(0, 1, 21) if method == "greedy_sweep" else [0.5]
    best = None
    for w in weights:
        taken = selection.walk(selection.ordered(v, b, c, rows[0][5], rows[0][6], "greedy_ratio" if method == "greedy_sweep" else method, float(w)), b, c, rows[0][5], rows[0][6])
        value = float(sum(v[taken].tolist()))
        if best is None or value > best[1]:
            best = (taken, value, float(w) if method == "greedy_sweep" else None)
    return [rows[i][1] for i in best[0]], best[1], best[2], len(rows), selection.binding(b, c, best[0], rows[0][5], rows[0][6])


def groups(seed):
    rng = random.Random(seed)
    out = []
    for g, n in (("few", 9), ("many", 900), ("free", 40), (None, 60)):
        budget_b, budget_c = rng.choice([20.0, 55.5]), rng.choice([30.0, 1e6])
        costs = [0.0] if g == "free" else [0.0, 0.1, 1.0, 2.5, 7.0, 100.0]
        out += [(g, i, rng.choice([1.0, 1.0, 2.0, rng.random() * 3, 0.0]), rng.choice(costs), rng.choice(costs), budget_b, budget_c) for i in range(n)]
    return out


@pytest.mark.parametrize("method", ["score_first", "greedy_ratio", "greedy_sweep"])
def test_pruned_walks_equal_whole_ones(spark, method):
    rows = groups(len(method))
    got = selection.greedy_arrow(spark.createDataFrame(rows, SCHEMA).repartition(5), ["g"], method).collect()
    want = {g: whole([r for r in rows if r[0] == g], method) for g in {r[0] for r in rows}}
    assert {r.g: (list(r.selected), r.total_value, r.best_weight, r.n_candidates, r.binding_constraint) for r in got} == want


def test_a_hot_group_is_cut_below_its_shuffle(spark):
    """Of 50,000 items of three costs, no more than fit reach the task that walks."""
    rows = spark.range(50_000).selectExpr("'hot' AS g", "id AS idx", "cast(id % 101 AS double) AS v", "cast(1 + id % 3 AS double) AS b", "1D AS c", "30D AS budget_b", "1e9D AS budget_c")
    some = selection.reachable(rows, ["g"], "score_first")
    assert some.count() == 32 + 17 + 12
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    plan = selection.greedy(rows, ["g"], "score_first").first()
    assert plan.n_candidates == 50_000 and plan.used_bits <= 30 and plan.binding_constraint == "bits"


def test_a_sweep_does_not_copy_its_candidates(spark):
    """One group a key walks all weights; rows aren't multiplied by them before or after the shuffle."""
    items = spark.createDataFrame(groups(3), SCHEMA)
    plan = selection.greedy_arrow(items, ["g"], "greedy_sweep")._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "_weight" not in plan.replace("best_weight", "")


@pytest.mark.parametrize("rows", [50, 1 << 17])
def test_many_small_groups_walk_together_as_alone(spark, monkeypatch, rows):
    """Groups cut out of batches at any place, walked in step and alone, give the plans of whole walks."""
    rng = random.Random(7)
    items = []
    for g in (None, *range(400)):
        budget_b, budget_c = rng.choice([9.0, 20.5, 1e9]), rng.choice([11.0, 30.0])
        items += [(g, i, rng.choice([1.0, 2.0, rng.random() * 3, -1.0, 0.0, 1e300]), rng.choice([0.0, 0.1, 1.0, 2.5, 7.0]), rng.choice([0.0, 0.3, 1.0, 3.0]), budget_b, budget_c) for i in rng.sample(range(1000), rng.choice([1, 2, 7, 40]))]
    frame = spark.createDataFrame(items, SCHEMA.replace("g string", "g long"))
    monkeypatch.setattr(selection, "ROWS", rows)
    monkeypatch.setattr(selection, "CELLS", 2000 if rows == 50 else 1 << 20)
    monkeypatch.setattr(selection, "LANES", 30)
    methods = ["random", "score_first", "greedy_ratio", "greedy_sweep"]
    got = selection._planned(frame.repartition(3), ["g"], methods, 0, 21).collect()
    found = {(r._walk, r.g): (list(r.selected), r.total_value, r.best_weight, r.n_candidates, r.binding_constraint) for r in got}
    by = {g: [r for r in items if r[0] == g] for g in {r[0] for r in items}}
    assert found == {(m, g): whole(own, m) for m in methods for g, own in by.items()} and len(got) == len(found)


def test_methods_share_one_copy_of_candidates_that_cannot_be_cut(spark):
    """One task call for many groups and all methods, and no ranks where every group's items of a cost fit."""
    items = spark.range(3000).selectExpr("cast(id % 100 AS string) AS g", "id AS idx", "cast(id % 17 AS double) AS v", "cast(id AS double) + 1 AS b", "1D AS c", "3000D AS budget_b", "1000D AS budget_c")
    plan = selection.greedy_by_methods(items, ["g"], ["random", "score_first", "greedy_sweep"])
    said = plan._jdf.queryExecution().executedPlan().toString()
    assert said.count("MapInArrow") == 1 and said.count("Exchange") == 1
    assert "FlatMapGroups" not in said and "Window" not in said
    assert plan.groupBy("_walk").count().orderBy("_walk").collect() == [("greedy_sweep", 100), ("random", 100), ("score_first", 100)]


def test_a_few_items_too_many_of_a_cost_rank_nothing(spark):
    """One group with more of a cost than fits does not make all groups' items be ranked; the plans stay those of whole walks."""
    items = [(str(g), i, float(i * 7 % 11), 1.0 if g == 0 else 1.0 + i, 1.0, 12.0 if g == 0 else 60.0, 100.0) for g in range(30) for i in range(30)]
    frame = spark.createDataFrame(items, SCHEMA)
    plan = selection.greedy_arrow(frame, ["g"], "greedy_sweep")
    assert "Window" not in plan._jdf.queryExecution().executedPlan().toString()
    found = {r.g: (list(r.selected), r.total_value, r.best_weight, r.n_candidates, r.binding_constraint) for r in plan.collect()}
    assert found == {str(g): whole([r for r in items if r[0] == str(g)], "greedy_sweep") for g in range(30)}
