"""Numbering, order statistics, digest trees and array files, against simple loops and numpy."""

from __future__ import annotations

import hashlib
import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from relaycast.operators import digests, quantiles
from relaycast.operators.numbering import numbered, numbered_within, running
from relaycast.session import stored
from relaycast.sources import tensors


# ---------------------------------------------------------------- numbering


def test_numbered_with_nulls_ties_and_falling_keys(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([None, 1, 1, 1, 2]), rng.choice("ab")) for i in range(500)]
    df = spark.createDataFrame(rows, "i long, k long, s string").repartition(7)
    got = {r.i: r.place for r in numbered(df, F.col("k").asc_nulls_last(), F.desc("s"), "i").collect()}
    want = sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, -ord(r[2]), r[0]))
    assert got == {r[0]: n for n, r in enumerate(want)}
    first = {r.i: r.n for r in numbered(df, F.col("k").asc_nulls_first(), "i", name="n", start=1).collect()}
    assert first == {r[0]: n for n, r in enumerate(sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0])), 1)}


def test_one_key_is_split_by_the_next(spark):
    """A first key that all rows share doesn't put them in one task."""
    df = spark.range(20_000).select(F.lit(1).alias("k"), F.col("id"))
    assert df.repartitionByRange(8, "k", "id").select(F.spark_partition_id().alias("p")).distinct().count() > 1
    got = numbered(df, "k", F.desc("id"))
    assert got.filter(F.col("place") != 19_999 - F.col("id")).count() == 0 and got.count() == 20_000


def test_numbered_within_groups(spark):
    rows = [(i, None if i % 3 == 0 else "a" if i % 3 == 1 else "b") for i in range(90)]
    got = {(r.i, r.g): r.n for r in numbered_within(spark.createDataFrame(rows, "i long, g string"), ["g"], F.desc("i"), name="n", start=1).collect()}
    want = {}
    for g in (None, "a", "b"):
        for n, r in enumerate(sorted((r for r in rows if r[1] == g), reverse=True, key=lambda r: r[0]), 1):
            want[r] = n
    assert got == want


def test_numbered_nothing(spark):
    assert numbered(spark.createDataFrame([], "i long"), "i").collect() == []


# ---------------------------------------------------------------- order statistics


@pytest.mark.parametrize(
    "values",
    [
        [3.0],
        [1.0, 2.0],
        [5.0] * 9000 + [7.0],
        [-1e308, 1e308, 0.0, 5e-324, -5e-324, 1.0],
        [float(i % 13) for i in range(9000)],
        [math.exp(i / 20) * (-1) ** i for i in range(9001)],
        [float("inf"), float("-inf"), 1.0, float("-inf")],
        [1.0, 1.0 + 2**-52, 1.0 + 2**-51] * 3000,
    ],
)
def test_every_kind_of_value(spark, values):
    df = spark.createDataFrame([(v,) for v in values] + [(None,)] * 3, "x double")
    want = sorted(values)
    for k in {0, len(values) // 2, len(values) - 1, (len(values) - 1) // 2}:
        assert quantiles.kth(df, "x", k) == want[k]
    with pytest.raises(ValueError):
        quantiles.kth(df, "x", len(values))


def test_median(spark, monkeypatch):
    rng = np.random.default_rng(4)
    monkeypatch.setattr(quantiles, "FEW", 10)
    monkeypatch.setattr(quantiles, "RANGES", 16)
    for n in (1, 2, 999, 1000):
        x = rng.normal(size=n) * 10.0 ** rng.integers(-9, 9, n)
        assert math.isclose(quantiles.median(spark.createDataFrame([(float(v),) for v in x], "x double"), "x"), float(np.median(x)), rel_tol=1e-12)
    assert quantiles.median(spark.createDataFrame([], "x double"), "x") is None
    assert quantiles.median(spark.createDataFrame([(None,)], "x double"), "x") is None
    assert math.isnan(quantiles.median(spark.createDataFrame([(1.0,), (math.nan,)], "x double"), "x"))


# ---------------------------------------------------------------- digests


def sha(lines):
    return hashlib.sha256("".join(x + "\n" for x in lines).encode()).hexdigest()


def root(lines, run):
    level = [sha(lines[i : i + run]) for i in range(0, len(lines), run)]
    while len(level) > 1:
        level = [sha(level[i : i + run]) for i in range(0, len(level), run)]
    return level[0]


def test_digest_tree(spark):
    rng = random.Random(6)
    rows = [(g, f"{rng.random()}") for g, n in (("a", 100), ("b", 1), (None, 17), ("c", 4)) for _ in range(n)] + [("a", "same")] * 9 + [("b", None)]
    made = digests.tree(spark.createDataFrame(rows, "g string, x string").repartition(5), "g", F.col("x"), run=4)
    want = {g: root(sorted(x or "" for k, x in rows if k == g), 4) for g in ("a", "b", "c", None)}
    assert {r.key: r.digest for r in digests.roots(made).collect()} == want
    assert {r.key: r.n_lines for r in digests.roots(made).collect()} == {"a": 109, "b": 2, "c": 4, None: 17}
    nodes = made.groupBy("level").agg(F.max("node").alias("most")).collect()
    assert max(r.level for r in nodes) == 3
    with pytest.raises(ValueError):
        digests.tree(spark.createDataFrame(rows, "g string, x string"), "g", F.col("x"), run=1)


def test_changes_are_located(spark):
    old = [(g, f"{i:05d}") for g in "ab" for i in range(300)]
    new = [r for r in old if r != ("a", "00299")] + [("c", "1")]
    new[57] = ("a", "00057x")
    trees = [digests.tree(spark.createDataFrame(rows, "g string, x string"), "g", F.col("x"), run=8) for rows in (old, new)]
    assert sorted(map(tuple, digests.changed(*trees, run=8).collect())) == [("a", 7), ("a", 37), ("c", 0)]
    assert digests.changed(trees[0], trees[0], run=8).count() == 0


# ---------------------------------------------------------------- array files


@pytest.fixture
def array(tmp_path):
    a = np.random.default_rng(2).normal(size=(700, 4, 3, 2)).astype(np.float32)
    np.save(tmp_path / "a.npy", a)
    return a, str(tmp_path / "a.npy")


def values(df):
    return np.array([r["values"] for r in df.orderBy("index").collect()])


def test_a_file_is_read_by_many_tasks(spark, array):
    a, path = array
    df = tensors.read_tensors(spark, path, partitionBytes=5000, chunkBytes=700)
    assert df.rdd.getNumPartitions() == math.ceil(700 / (5000 // 96))
    assert np.array_equal(values(df), a.reshape(700, -1)) and [r["index"] for r in df.orderBy("index").collect()] == list(range(700))
    assert np.array_equal(values(df), a.reshape(700, -1))  # and again
    assert tensors.read_tensors(spark, f"file://{path}").count() == 700


@pytest.mark.parametrize("options, want", [({"limit": 5}, range(5)), ({"from": 690}, range(690, 700)), ({"from": 10, "to": 13}, range(10, 13)), ({"from": 10, "limit": 4, "to": 12}, range(10, 12)), ({"from": 800}, range(0)), ({"limit": 0}, range(0))])
def test_only_asked_rows_are_planned(spark, array, options, want):
    a, path = array
    df = tensors.read_tensors(spark, path, **options)
    got = df.orderBy("index").collect()
    assert [r["index"] for r in got] == list(want) and all(np.array_equal(r["values"], a[r["index"]].ravel()) for r in got)
    low, high = options.get("from", 0), min(options.get("to", 700), options.get("limit", 700) + options.get("from", 0))
    assert sum(p.rows for p in tensors.plan(path, low, high)[0]) == len(want)


def test_chunks_are_bounded_and_can_be_read_again(array):
    a, path = array
    part = tensors.plan(path)[0][0]
    for _ in range(2):
        sizes = [b.num_rows for b in tensors.chunks(part, 960)]
        assert max(sizes) == 10 and sum(sizes) == 700


@pytest.mark.parametrize("dtype", ["float64", ">f4", "int16", "uint8", "int64"])
def test_kinds_of_values(spark, tmp_path, dtype):
    a = np.arange(60).reshape(12, 5).astype(dtype)
    np.save(tmp_path / "x.npy", a)
    assert np.array_equal(values(tensors.read_tensors(spark, str(tmp_path / "x.npy"))), a)


def test_unfit_files_fail(spark, tmp_path, array):
    _, path = array
    with open(path, "r+b") as f:
        f.truncate(5000)
    with pytest.raises(Exception, match="ends after 50 of its 700 rows"):
        tensors.read_tensors(spark, path).count()
    np.save(tmp_path / "f.npy", np.asfortranarray(np.ones((3, 4))))
    np.save(tmp_path / "s.npy", np.float32(3))
    np.save(tmp_path / "o.npy", np.array(["a", "b"]))
    (tmp_path / "t.npy").write_text("no array")
    for name, text in (("f", "by columns"), ("s", "one value"), ("o", "no column type"), ("t", "no array header"), ("none", "none.npy")):
        with pytest.raises(Exception, match=text):
            tensors.read_tensors(spark, str(tmp_path / f"{name}.npy")).count()


def test_one_file_equals_numpy_save(spark, tmp_path, array):
    a, path = array
    df = stored(tensors.read_tensors(spark, path).repartition(6), "rows")
    assert tensors.write_array(df, str(tmp_path / "b.npy"), (4, 3, 2), "index") == 700
    assert (tmp_path / "b.npy").read_bytes() == open(path, "rb").read()
    np.save(tmp_path / "c.npy", a[::-1].astype(np.float64))
    tensors.write_array(df, str(tmp_path / "d.npy"), (4, 3, 2), F.desc("index"), dtype="float64")
    assert (tmp_path / "c.npy").read_bytes() == (tmp_path / "d.npy").read_bytes()


def test_a_short_file_is_trimmed_and_a_long_one_refused(spark, tmp_path, array):
    a, path = array
    df = tensors.read_tensors(spark, path)
    assert tensors.write_array(df.filter("index % 7 = 0"), str(tmp_path / "b.npy"), (4, 3, 2), "index", planned=50_000) == 100
    np.save(tmp_path / "c.npy", a[::7])
    assert (tmp_path / "b.npy").read_bytes() == (tmp_path / "c.npy").read_bytes()
    with pytest.raises(ValueError, match="700 rows for an array of 10"):
        tensors.write_array(df, str(tmp_path / "e.npy"), (4, 3, 2), "index", planned=10)
    with pytest.raises(Exception, match="not 5"):
        tensors.write_array(df, str(tmp_path / "e.npy"), (5,), "index")
    assert not [x for x in os.listdir(tmp_path) if x.startswith("e.npy")]


def test_files_are_committed_together(spark, tmp_path, array):
    a, path = array
    df, out = tensors.read_tensors(spark, path), str(tmp_path / "out")
    tensors.write_tensors(df, out, (4, 3, 2), fileBytes=2000)
    assert np.array_equal(values(tensors.read_tensors(spark, out)), a.reshape(700, -1))
    np.save(f"{out}/stray.npy", np.ones((5, 4, 3, 2), np.float32))  # of an attempt that was never committed
    assert tensors.read_tensors(spark, out).count() == 700
    tensors.write_tensors(df.limit(3), out, (4, 3, 2), mode="append")
    assert tensors.read_tensors(spark, out).count() == 703
    with pytest.raises(Exception, match="don't join"):
        tensors.write_tensors(df.limit(3), out, (24,), mode="append")
    with pytest.raises(Exception, match="not 23"):
        tensors.write_tensors(df, out, (23,))
    assert tensors.read_tensors(spark, out).count() == 703
    tensors.write_tensors(df.filter("index < 0"), out, (4, 3, 2))
    assert tensors.read_tensors(spark, out).count() == 0


def test_running_totals_over_spans(spark):
    rows = [(g, i, i % 5) for g in ("a", None) for i in range(40)]
    got = running(spark.createDataFrame(rows, "g string, p long, x long"), ["g"], "p", span=7, total="x").collect()
    assert {(r.g, r.p): r.total for r in got} == {(g, i): sum(k % 5 for k in range(i + 1)) for g in ("a", None) for i in range(40)}
