"""Hand-computed cases and invariants of the mission operators."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from relaycast.functions import cost, labels, text, vectors
from relaycast.operators import integrity, pca, ranking, replay, selection, windows
from relaycast.sources import manifests


def ranked(spark, rows):
    return spark.createDataFrame([(i, y, float(s)) for i, (y, s) in enumerate(rows)], "idx long, y int, s double")


@pytest.mark.parametrize(
    ("rows", "auc"),
    [
        ([(0, 0.1), (0, 0.2), (0, 0.3), (1, 0.7), (1, 0.8), (1, 0.9)], 1.0),
        ([(0, 0.9), (0, 0.8), (1, 0.2), (1, 0.1)], 0.0),
        ([(0, 5), (1, 5), (0, 5), (1, 5)], 0.5),
        ([(1, 0.4), (1, 0.8), (0, 0.1), (0, 0.5), (0, 0.9)], 0.5),
    ],
)
def test_auc(spark, rows, auc):
    assert ranking.roc_auc(ranked(spark, rows)).first().roc_auc == pytest.approx(auc)


def test_precision_recall_are_pessimistic_and_clamp(spark):
    k = ranking.pessimistic_rank(ranked(spark, [(1, 1.0), (0, 1.0)]))
    assert ranking.precision_at_k(k, [1]).first().precision == 0
    k = ranking.pessimistic_rank(ranked(spark, [(1, 0.9), (1, 0.8), (0, 0.7), (0, 0.6), (1, 0.1)]))
    assert {r.k: round(r.precision, 9) for r in ranking.precision_at_k(k, [2, 4, 100]).collect()} == {2: 1, 4: 0.5, 100: 0.6}
    assert {r.k: round(r.recall, 3) for r in ranking.recall_at_k(k, [2, 5]).collect()} == {2: 0.667, 5: 1}
    assert ranking.recall_at_k(k, [0]).first().k == 1
    with pytest.raises(ValueError):
        ranking.precision_at_k(k, [0])


def test_scores_are_validated(spark):
    with pytest.raises(Exception, match="finite"):
        ranking.validated(ranked(spark, [(0, float("nan")), (1, 1)])).collect()


def test_names(spark):
    cases = {"mcam00487_R0_sol0069_7.npy": (69, "R"), "mcam00117_MR_0_sol0024_39.npy": (24, "MR"), "mcam07566_R0_sol1496_4.npy": (1496, "R"), "no_day_here.npy": (None, None), "": (None, None), "solaris.npy": (None, None), "12345.npy": (None, None)}
    df = spark.createDataFrame([(k,) for k in cases], "n string").select("n", labels.frame_meta(F.col("n")).alias("m"))
    assert {r.n: (r.m.sol, r.m.camera) for r in df.collect()} == cases


def candidates(spark, rows, b, c):
    return spark.createDataFrame([(0, i, float(v), float(x), float(y), float(b), float(c)) for i, (v, x, y) in enumerate(rows)], "g int, idx long, v double, b double, c double, budget_b double, budget_c double")


@pytest.mark.parametrize("pick", [selection.greedy, selection.greedy_arrow])
def test_greedy_cases(spark, pick):
    r = pick(candidates(spark, [(100, 1e6, 1), (1, 10, 1), (1, 10, 1), (1, 10, 1)], 100, 100), ["g"], "score_first").first()
    assert sorted(r.selected) == [1, 2, 3]
    r = pick(candidates(spark, [(1, 10, 100)] * 10, 1000, 350), ["g"], "score_first").first()
    assert (len(r.selected), r.binding_constraint) == (3, "cycles")
    r = pick(candidates(spark, [(1, 0, 0), (5, 100, 100)], 1, 1), ["g"], "greedy_ratio").first()
    assert r.selected == [0]


def test_budgets_hold_and_bound_is_a_bound(spark):
    rng = np.random.default_rng(7)
    items = candidates(spark, list(zip(rng.gamma(2, 1, 200), rng.uniform(1e3, 1e4, 200), rng.uniform(1e5, 1e6, 200), strict=True)), 100_000, 1e7)
    bound = selection.fractional_bound(items, ["g"]).first().upper_bound
    got = {m: selection.greedy_arrow(items, ["g"], m).first() for m in ("score_first", "greedy_ratio", "greedy_sweep", "random")}
    assert all(r.used_bits <= 100_000 and r.used_cycles <= 1e7 and r.total_value <= bound + 1e-9 for r in got.values())
    assert got["greedy_sweep"].total_value >= got["score_first"].total_value > got["random"].total_value
    same = selection.greedy(items, ["g"], "greedy_ratio").first()
    assert same.selected == got["greedy_ratio"].selected


def test_invalid_candidates(spark):
    with pytest.raises(Exception, match="positive"):
        selection.validated(candidates(spark, [(1, 1, 1)], 0, 1)).collect()


def test_anchored_windows_skip_gaps_and_keep_undated(spark):
    df = spark.createDataFrame([(1, 13), (2, 40), (3, 63), (4, 200), (5, None)], "idx long, sol long")
    w = windows.anchored_windows(df, 50)
    assert [tuple(r) for r in w.orderBy("window").collect()] == [(0, 13, 40), (1, 63, 63), (2, 200, 200), (3, -1, -1)]
    assert {r.idx: r.window for r in windows.with_windows(df, w).collect()} == {1: 0, 2: 0, 3: 1, 4: 2, 5: 3}


def mission(n=48):
    groups = np.array(["natural"] * 12 + ["rover"] * 12 + ["typical"] * 24, dtype=object)
    order = np.random.default_rng(0).permutation(n)
    level = np.where(groups == "natural", 200.0, 100.0)[order]
    return replay.Frames(np.arange(n), 10 + 5 * np.arange(n), groups[order], np.full(n, 1000.0), level[:, None], level)


TIGHT = replay.Config(sols_per_window=40, compute_fraction=0.5, max_age=60, cycles_per_score=866_432 * 3.0)


@pytest.mark.parametrize("method", replay.POLICIES)
def test_replay_invariants(method):
    f = mission()
    log, s = replay.replay(f, method, TIGHT)
    sent = [i for r in log for i in r["selected_indices"]]
    assert len(set(sent)) == len(sent) == s["n_sent"]
    assert all(r["bits_used"] <= r["bits_budget"] + 1e-9 for r in log)
    assert s["n_sent"] + s["n_expired"] + s["n_remaining"] == len(f.idx)
    assert all(a["cum_sent_natural"] <= b["cum_sent_natural"] for a, b in zip(log, log[1:], strict=False))
    assert replay.replay(f, method, TIGHT) == (log, s)
    if method == "fifo":
        assert sent == sorted(sent)
    if method not in replay.SCORE_BASED:
        assert s["prefilter_recall_natural"] == 1.0


def test_oracle_and_unlimited_compute_do_no_worse():
    f = mission()
    yields = {m: replay.replay(f, m, TIGHT)[1]["science_yield"] for m in replay.POLICIES}
    assert yields["oracle"] >= yields["score_first"] >= yields["fifo"]


def test_refit_memo_changes_nothing():
    f = mission()
    cfg = replay.Config(**{**TIGHT.__dict__, "adaptation": "online", "bootstrap_sols": 60, "refit_every": 2})
    memo: dict = {}
    first = replay.replay(f, "score_first", cfg, replay.nearest_to_mean(f), memo)
    assert memo and replay.replay(f, "score_first", cfg, replay.nearest_to_mean(f), memo) == first == replay.replay(f, "score_first", cfg, replay.nearest_to_mean(f))


def test_undated_frames_come_last_and_fifo_sends_them_first_there():
    f = mission()
    f.sol[-3:] = -1
    log, _ = replay.replay(f, "fifo", TIGHT)
    assert (log[-1]["first_sol"], log[-1]["last_sol"]) == (-1, -1)
    assert log[-1]["selected_indices"][0] == f.idx[-3]


def test_cost_model():
    assert cost.pca_flops() == 866_432
    assert cost.frames_per_window(8_000_000) == 162
    with pytest.raises(ValueError):
        cost.frames_per_window(1)


def test_pca_components_and_residual(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((200, 3)) @ rng.standard_normal((3, 12)) + rng.standard_normal((200, 12)) * 0.01
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "k long, p array<double>")
    model = pca.fit(df, "p", 3)
    assert np.allclose(model.components @ model.components.T, np.eye(3), atol=1e-8)
    got = pca.residual_scores(df, "p", model, "k").orderBy("k").toPandas()
    c = x - x.mean(0)
    want = np.linalg.norm(c - c @ model.components.T @ model.components, axis=1)
    assert np.allclose(got.recon_l2, want, atol=1e-6)
    true = np.linalg.svd(c, full_matrices=False)[1][:3]
    assert np.allclose(model.singular, true, rtol=1e-6)


def test_downsample_and_variance(spark):
    a = [float(i) for i in range(32)]
    r = spark.createDataFrame([(a,)], "p array<double>").select(vectors.block_downsample(F.col("p"), 4, 4, 2, 2).alias("d"), vectors.population_variance(F.col("p")).alias("v")).first()
    want = np.array(a).reshape(4, 4, 2).reshape(2, 2, 2, 2, 2).mean(axis=(1, 3)).ravel()
    assert np.allclose(r.d, want) and r.v == pytest.approx(np.var(a))
    with pytest.raises(ValueError):
        vectors.block_downsample(F.col("p"), 3, 3, 1, 2)


def test_double_counts(spark):
    rows = spark.createDataFrame([("a", "x"), ("b", "x"), ("a", "y")], "name string, grp string")
    with pytest.raises(ValueError, match="'a'"):
        integrity.assert_no_double_count(rows, "name", "grp")
    with pytest.raises(ValueError):
        integrity.assert_splits_combinable(["test_novel_all", "test_novel_byclass"])


def test_text(spark):
    r = spark.createDataFrame([("1. sent 1,234 of 5.5, {{N_SENT}} v2 at +7.1%.\n  2) 3",)], "t string").select(text.numbers(F.col("t")).alias("n"), text.placeholders(F.col("t")).alias("p"), text.unsanctioned(F.col("t")).alias("u")).first()
    assert r.n == ["1", "1234", "5.5", "7.1", "2", "3"] and r.p == ["N_SENT"] and r.u == ["1,234", "5.5", "v2", "+7.1%", "3"]


def test_manifest_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(0, "s", "typical", 5, "a.npy"), (1, "s", "x|y", None, "b.npy")], "index long, split string, class string, sol long, source_filename string")
    manifests.write_manifest_csv(rows, str(tmp_path / "m"))
    assert sorted(map(tuple, manifests.read_manifest_csv(spark, str(tmp_path / "m")).collect())) == sorted(map(tuple, rows.collect()))
    manifests.write_manifest_parquet(rows, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2
    (tmp_path / "bad.csv").write_text("index,split\n1,a\n")
    with pytest.raises(ValueError, match="lacks"):
        manifests.read_manifest_csv(spark, str(tmp_path / "bad.csv"))


def test_arrays_and_folders(spark, tmp_path):
    for folder, name, a in (("all", "a", np.arange(4.0)), ("veins", "a", np.arange(4.0)), ("drt", "a", np.arange(4.0)), ("all", "b", np.arange(3.0))):
        (tmp_path / folder).mkdir(exist_ok=True)
        np.save(tmp_path / folder / f"{name}.npy", a)
    (tmp_path / "all" / "c.npy").write_bytes(b"no array")
    good, bad = manifests.read_arrays(spark, str(tmp_path), 4)
    assert good.count() == 3 and sorted(r.name for r in bad.collect()) == ["b.npy", "c.npy"]
    assert {r.name: r["class"] for r in manifests.class_folders(good).collect()} == {"a.npy": "drt|veins"}


def test_window_log_round_trip(spark, tmp_path):
    log, _ = replay.replay(mission(), "score_first", TIGHT)
    (tmp_path / "w.jsonl").write_text("\n".join(json.dumps(r) for r in log) + "\n\n")
    assert manifests.read_window_log(spark, str(tmp_path / "w.jsonl")).count() == len(log)


def test_conv_autoencoder_costs_and_transpose():
    from relaycast.operators import models

    assert models.build("conv_ae_myriad").flops_per_inference() == 9_428_992
    assert models.build("conv_ae_snapdragon").flops_per_inference() == 49_209_344
    rng = np.random.default_rng(0)
    x, y, w = rng.standard_normal((2, 3, 8, 8)), rng.standard_normal((2, 5, 4, 4)), rng.standard_normal((5, 3, 3, 3))
    zero = np.zeros(5), np.zeros(3)
    assert np.isclose((models.convolve(x, w, zero[0]) * y).sum(), (x * models.deconvolve(y, w, zero[1])).sum())
    m = models.ConvAutoencoder(4, 2, 8, (8, 8, 3)).seeded(1)
    f = rng.standard_normal((6, 8, 8, 3))
    assert np.allclose(np.concatenate([m.score(f[:2]), m.score(f[2:])]), m.score(f))
    with pytest.raises(KeyError):
        models.build("none")


def test_png_and_colour():
    import struct
    import zlib

    from relaycast.functions import images

    flat = images.colour(np.ones((4, 4, 3)), 2)
    assert (flat == 128).all()
    rgb = images.colour(np.random.default_rng(0).random((8, 8, 6)), 4)
    data = images.png(rgb)
    at, raw = 8, b""
    while at < len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        raw += data[at + 8 : at + 8 + n] if kind == b"IDAT" else b""
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(raw), np.uint8).reshape(4, 13)
    assert (rows[:, 1:].reshape(4, 4, 3) == rgb).all() and not rows[:, 0].any()


def test_run_records(spark, tmp_path):
    from relaycast.sources import records

    for tier, seed, p in (("a", 0, 0.7), ("a", 1, 0.8), (None, 0, 0.9)):
        name = f"{tier or 'b-x'}-s{seed}.json"
        (tmp_path / name).write_text(json.dumps({"tier": tier, "seed": seed, "metrics": {"roc_auc": 0.5, "precision_at_k": {"10": p}}}))
    runs = records.read_runs(spark, f"{tmp_path}/*.json")
    got = {r.tier: (round(r["mean"], 6), round(r.sd, 6), r.n) for r in records.mean_sd_by_tier(runs).collect()}
    assert got == {"a": (0.75, 0.05, 2), "b-x": (0.9, 0.0, 1)}
    cells = spark.createDataFrame([("h", "t", "f", "p", 1)], "hardware string, tier string, adaptation string, policy string, n int")
    records.write_grid(cells, f"{tmp_path}/grid")
    assert records.lookup(spark.read.parquet(f"{tmp_path}/grid"), hardware="h", tier="t").count() == 1
    records.write_results(cells, f"{tmp_path}/out", ["tier"])
    assert [r.value for r in spark.read.text(f"{tmp_path}/out/markdown").collect()][1:] == ["|---|---|---|---|---|", "| h | t | f | p | 1 |"]
    assert spark.read.option("header", True).csv(f"{tmp_path}/out/csv").count() == 1
    assert records.checksums(spark, f"{tmp_path}/a-s0.json").first().md5
    log = spark.createDataFrame([(0, "old"), (1, "old")], "window long, operator_note string")
    assert [r.operator_note for r in records.with_notes(log, spark.createDataFrame([(1, "new")], "window long, note string")).orderBy("window").collect()] == [None, "new"]


def test_published_text(spark):
    rows = [("so (**0.720 ± 0.004**).", "0.720 ± 0.004", "- {{A_B}}.\nyield of {{A}}\r\n**{{B}}**, {{C}}"), ("-0.047", "-0.047", None), ("", "1", "no figure"), ("ten of 75", "10 of 75", "")]
    out = spark.createDataFrame(rows, "shown string, value string, t string").select(text.last_words(F.col("shown"), F.col("value")).alias("w"), text.misplaced(F.col("t")).alias("m")).collect()
    assert [r.w for r in out] == ["0.720 ± 0.004", "-0.047", "", "ten of 75"]
    assert [r.m for r in out] == [["yield of {{A}}"], [], [], []]
