"""Fact sheets against plain dictionaries, rendered texts and their audit, configurations and catalogs."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from relaycast import config
from relaycast.functions import text
from relaycast.operators import facts, replay
from relaycast.sources import manifests
from tests.test_replay import CFG, ONLINE, rows, table_of

RUNS = [("fifo", "fifo", CFG), ("score_first", "score_first", ONLINE)]


@pytest.fixture(scope="module")
def replayed(spark):
    items = table_of(spark, rows())
    return replay.run_all(items, RUNS, fit=replay.principal(2)).cache(), replay.run_all(items, RUNS, log=False, fit=replay.principal(2)).cache()


def by_key(found, *keys):
    out: dict = {}
    for r in found.collect():
        out.setdefault(tuple(r[k] for k in keys), {})[r.key] = r.amount if r.amount is not None else r.shown
    return out


def test_window_facts(spark, replayed):
    log, _ = replayed
    got = by_key(facts.window_facts(log, F.lit(22)), "run", "window")
    assert len(got) == log.count()
    for w in log.collect():
        want = {"WINDOW": w.window, "SOLS": f"{w.first_sol}-{w.last_sol}", "ARRIVED": w.n_arrived, "BUFFERED": w.n_buffered, "SELECTED": w.n_selected, "SENT_BREAKDOWN": f"{w.sent_natural}, {w.sent_rover}, {w.sent_typical}"}
        want |= {"BINDING_CONSTRAINT": w.binding_constraint, "BITS_SHARE": w.bits_used / w.bits_budget, "CYCLES_SHARE": w.cycles_used / w.cycles_budget, "SCORED": w.n_scored, "UNSCORED": w.n_unscored, "CUM_YIELD": w.cum_science_yield}
        want |= {"EXPIRED": w.n_expired} if w.n_expired else {}
        want |= {"PREFILTER_RECALL": w.prefilter_recall} if w.prefilter_recall is not None else {}
        want |= {"CUM_YIELD_PROVISIONAL": "provisional"} if 0 < w.cum_natural_available < 11 else {}
        want |= {"REFIT": "true"} if w.refit else {}
        assert got[w.run, w.window] == want


def test_mission_facts_and_advice(spark, replayed):
    log, runs = replayed
    got = by_key(facts.mission_facts(log, runs), "run")
    summary = {r.run: r for r in runs.collect()}
    for run, s in summary.items():
        own, mine = sorted((w for w in log.collect() if w.run == run), key=lambda w: w.window), got[run,]
        assert mine["N_WINDOWS"] == len(own) and mine["SOL_RANGE"] == f"{own[0].first_sol}-{own[-1].last_sol}" and mine["POLICY"] == run
        assert mine["YIELD_DELTA_VS_FIFO"] == s.science_yield - summary["fifo"].science_yield
        assert mine["COMPUTE_LIMITED"] == sum(w.binding_constraint == "cycles" for w in own) and mine["BANDWIDTH_LIMITED"] == sum(w.binding_constraint == "bits" for w in own)
        worst = sorted((w for w in own if w.n_expired), key=lambda w: (-w.n_expired, w.window))[:3]
        assert mine.get("TOP_EXPIRY_WINDOWS") == (", ".join(f"{w.window}:{w.n_expired}" for w in worst) or None)
        recalls = [w.prefilter_recall for w in own if w.prefilter_recall is not None]
        assert mine.get("PREFILTER_RECALL_WINDOW_MEAN") == (pytest.approx(np.mean(recalls)) if recalls else None)
    assert "FIFO_SCIENCE_YIELD" not in by_key(facts.mission_facts(log, runs, fifo="none"), "run")["fifo",]
    said = {r.run: r.advice for r in facts.advice(log, runs).collect()}
    assert all(("took" in said[r]) == (s.wasted_bit_share > 0.1) and ("expired" in said[r]) == (s.n_expired > 50) for r, s in summary.items())


def test_texts_are_rendered_and_audited(spark, replayed):
    log, _ = replayed
    sheet, keys = facts.window_facts(log.filter("run = 'fifo'")), ["run", "window"]
    texts = sheet.select(*keys).distinct().withColumn("text", F.lit("{{ARRIVED}} frames came, {{NOTHING}} stayed."))
    notes = facts.rendered(texts, sheet, keys)
    arrived = {w.window: w.n_arrived for w in log.filter("run = 'fifo'").collect()}
    assert {r.window: (r.text, r.unknown) for r in notes.collect()} == {w: (f"{n} frames came, {{{{NOTHING}}}} stayed.", ["NOTHING"]) for w, n in arrived.items()}
    assert facts.unsupported(notes, sheet, keys).count() == 0
    lied = notes.withColumn("text", F.concat("text", F.lit(" 98765.4 were lost.")))
    assert {r.number for r in facts.unsupported(lied, sheet, keys).collect()} == {"98765.4"}
    first = facts.catalogue(sheet, keys).first().placeholders
    assert first.startswith("{{WINDOW}} {{SOLS}} {{ARRIVED}}")
    assert facts.unsupported(notes.limit(0), sheet, keys).count() == 0
    # The same placeholders are what a text's checks see: a line of a sheet's own ones alone is none of their business.
    lines = facts.catalogue(sheet, keys).select(F.col("placeholders").alias("pure"), F.concat(F.lit("It sent "), "placeholders").alias("mixed"))
    for r in lines.select(text.misplaced(F.col("pure")).alias("p"), text.misplaced(F.col("mixed")).alias("m"), text.unsanctioned(F.col("mixed")).alias("u"), "mixed").collect():
        assert (r.p, r.m, r.u) == ([], [r.mixed], [])


def test_configurations():
    base = {"a": {"b": 1, "c": [1]}, "d": 2}
    assert config.merged(base, {"a": {"b": {"x": 0}}}, None) == {"a": {"b": {"x": 0}, "c": [1]}, "d": 2} and base["a"]["b"] == 1
    assert config.overrides(["a.b=3", "a.c=true", "a.d=null", "e=0.5", "f='7'", "g=[1, 2]", "h=x=y", "a.b=4"]) == {"a": {"b": 4, "c": True, "d": None}, "e": 0.5, "f": "7", "g": [1, 2], "h": "x=y"}
    for layers, want in (([{"a": {"b": 1}}, {"a": 2}], {"a": 2}), ([{"a": 2}, {"a": {"b": 1}}], {"a": {"b": 1}}), ([{"a": {"b": 1}}, {"a": {}}], {"a": {"b": 1}}), ([{"a": 1}, {"a": {}}], {"a": {}}), ([{"a": {}}, {"a": {"b": None}}], {"a": {"b": None}}), ([{}], {})):
        assert config.merged(*layers) == want
    with pytest.raises(ValueError):
        config.overrides(["seed"])
    assert config.canonical({"b": 1, "a": [None, "é"]}) == '{"a":[null,"\\u00e9"],"b":1}'
    assert config.config_sha256({"b": 1, "a": 2}) == config.config_sha256({"a": 2, "b": 1}) == hashlib.sha256(b'{"a":2,"b":1}').hexdigest()
    x = np.arange(6, dtype=np.float32).reshape(2, 3)
    assert config.arrays_sha256({"x": x}) == hashlib.sha256(b"x<f4(2, 3)" + x.tobytes()).hexdigest() == config.arrays_sha256({"x": np.asfortranarray(x)})
    assert config.arrays_sha256({"x": x}) != config.arrays_sha256({"x": x.T})


def test_catalog_and_splits(spark, tmp_path):
    files = spark.createDataFrame([("a", "vein", "x.npy", 3), ("a", "vein", "y.npy", 3), ("b", None, "z.npy", 1)], "split string, class string, name string, length long")
    rows_ = files.select("split", F.col("name").alias("source_filename"), F.lit(1).alias("sol"))
    known = manifests.catalog(rows_).join(manifests.fingerprints(files), "split")
    manifests.write_catalog(known, str(tmp_path / "c"))
    read = manifests.read_catalog(spark, str(tmp_path / "c"))
    assert sorted(map(tuple, read.collect())) == sorted(map(tuple, known.select(*read.columns).collect()))
    assert manifests.stale_splits(files.repartition(5).orderBy(F.desc("name")), read).count() == 0
    changed = files.withColumn("length", F.when(F.col("name") == "z.npy", 2).otherwise(F.col("length")))
    assert [r.split for r in manifests.stale_splits(changed, read).collect()] == ["b"]
    read.withColumn("format_version", F.lit(9)).write.json(str(tmp_path / "d"))
    with pytest.raises(ValueError):
        manifests.read_catalog(spark, str(tmp_path / "d"))
    m = spark.createDataFrame([("a", 0, "vein"), ("a", 1, "drt"), ("b", 0, "x")], "split string, index long, class string")
    t = spark.createDataFrame([("a", 1, [1.0]), ("a", 0, [0.0]), ("b", 5, [2.0])], "split string, index long, pixels array<double>")
    assert sorted((r["index"], r["class"], r.pixels) for r in manifests.load_split(m, t, "a").collect()) == [(0, "vein", [0.0]), (1, "drt", [1.0])]
    with pytest.raises(Exception, match="no partner"):
        manifests.load_split(m, t, "b").collect()
