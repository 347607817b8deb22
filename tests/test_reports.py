"""Reports over nested run records: figures with lineage, tables, missing fields."""

from __future__ import annotations

import json

import numpy as np
import pytest

from relaycast.functions.labels import NATURAL, ROVER
from relaycast.operators import reports
from relaycast.sources import records

GROUPS = {c: "natural" for c in NATURAL} | {c: "rover" for c in ROVER}


def record(tier, seed, p10, p162):
    flops = {"rad750": 866_432, "snapdragon": 49_209_344}[tier]
    return {
        "tier": tier, "seed": seed, "metrics": {"roc_auc": 0.6 + seed / 100, "precision_at_k": {"10": p10, "162": p162}, "recall_at_k": {"10": 0.1}},
        "decomposed": {"natural": {"n": 58, "roc_auc": 0.7}, "rover": {"n": 360, "roc_auc": 0.55}, "excluded": {"n": 12, "roc_auc": None}},
        "per_class_roc_auc": {"veins": {"n": 30, "roc_auc": 0.8 + seed / 10}, "drt": {"n": 111, "roc_auc": 0.5}, "other": {"n": 2, "roc_auc": 0.4}},
        "cost": {"param_count": 1000, "flops_per_inference": flops, "cycles_per_inference": 1.0, "wall_clock_seconds": 2.0},
    }


@pytest.fixture
def sweep(tmp_path):
    for r in (record("rad750", 0, 0.9, 0.75), record("rad750", 1, 0.9, 0.76), record("snapdragon", 0, 1.0, 0.70), record("snapdragon", 1, 1.0, 0.71)):
        (tmp_path / f"{r['tier']}-s{r['seed']}.json").write_text(json.dumps(r))
    return tmp_path


def lines(spark, path):
    runs = records.read_runs(spark, str(path))
    made = reports.tier_report(runs, 162, 3.0, 20e6, GROUPS, {"rad750": (3.0, 20e6), "snapdragon": (0.1, 20e6)})
    rows = made.orderBy("line_no").collect()
    assert [r.line_no for r in rows] == list(range(len(rows)))
    return [r.line for r in rows]


def test_headline_curve_and_classes(spark, sweep):
    text = "\n".join(lines(spark, sweep))
    head, curve = text.split("## Precision at k")
    curve, classes = curve.split("## ROC AUC by class")
    # The window's precision leads; other k are in the curve alone, where their column says which the window is.
    assert "p@window" in head and "p@10" not in head and "p@162 (window)" in curve and "p@10" in curve
    assert "| rad750 | 0.755 ± 0.005 | 0.700 ± 0.000 | 0.550 ± 0.000 | 0.605 ± 0.005 | 1,000 | 866,432 | 13.00% | 2,599,296 | 13% |" in head
    # What a model costs on its own processor stands beside what it costs on the shared one.
    assert "| 24.60% | 147,628,032 | **738%** |" in head and "can't be compared between rows" in head
    assert "| snapdragon | 1.000 ± 0.000 | 0.705 ± 0.005 |" in curve
    assert classes.index("### natural") < classes.index("| veins | 30 | 0.850 ± 0.050 | 0.850 ± 0.050 |") < classes.index("### rover") < classes.index("| drt | 111 |") < classes.index("### excluded") < classes.index("| other | 2 |")


def test_figures_carry_their_lineage(spark, sweep):
    made = {(r.tier, r.k): r for r in reports.run_figures(records.read_runs(spark, str(sweep)))["curve"].collect()}
    r = made["rad750", 162]
    assert (r.n, r.text, r.source) == (2, "0.755 ± 0.005", "runs.metrics.precision_at_k where tier=rad750 and k=162: mean of value over 2 runs")
    assert np.isclose(r["mean"], 0.755) and np.isclose(r.sd, 0.005)


def test_missing_fields_are_named_and_the_rest_is_written(spark, sweep):
    victim = sweep / "snapdragon-s1.json"
    r = json.loads(victim.read_text())
    del r["per_class_roc_auc"]
    r["metrics"]["roc_auc"] = None
    victim.write_text(json.dumps(r))
    runs = records.read_runs(spark, str(sweep))
    found = reports.incomplete(runs, ["tier", "seed"], ["metrics.roc_auc", "per_class_roc_auc", "decomposed"])
    assert [tuple(x) for x in found.collect()] == [("snapdragon", 1, ["roc_auc", "per_class_roc_auc"])]
    text = "\n".join(lines(spark, sweep))
    assert "| veins | 30 | 0.850 ± 0.050 | 0.800 |" in text and "0.600 |" in text


def test_tables_have_a_bound(spark):
    made = spark.range(300).selectExpr("'t' AS tier", "id AS k", "1D AS value")
    with pytest.raises(ValueError, match="columns in one table"):
        reports.columns_of(made, "k")
    with pytest.raises(ValueError, match="columns in one table"):
        reports.wide(made, ["tier"], "k", list(range(300)))


def test_numbers_order_as_numbers(spark):
    rows = spark.createDataFrame([(i, f"r{i}") for i in (10, 9, 100, 1)], "k long, name string")
    got = [r.line for r in reports.document([reports.table_lines(rows, {"name": "name"}, "k", section=0)]).orderBy("line_no").collect()]
    assert got == ["| name |", "|---|", "| r1 |", "| r9 |", "| r10 |", "| r100 |"]
