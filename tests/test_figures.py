"""Marked and unmarked figures, and what buffers hold, against plain loops."""

from __future__ import annotations

import random
import re

import ahocorasick
import pytest
from pyspark.sql import functions as F

from relaycast.operators import figures, occupancy
from relaycast.plans import reports

KNOWN = [("YIELD", 0.556, "55.6%", "runs/a"), ("SPREAD", 0.72, "0.720 ± 0.004", "runs"), ("DELTA", -0.047, "-0.047", "runs/b"), ("ZERO", 0.0, "0.000", "runs/c"), ("COUNT", 26.0, "26", "runs/d"), ("TOTAL", 1234.5, "1,234.5", "runs/e"), ("AGAIN", 1234.5, "1,234.5", "runs/f"), ("LONG", 234.5, "234.5", "runs/g")]


@pytest.fixture(scope="module")
def known(spark):
    return spark.createDataFrame(KNOWN, "key string, value double, text string, source string")


def problems(spark, known, text):
    return [(r.line, r.key, r.written, r.problem) for r in figures.marked(spark.createDataFrame([(1, text)], "doc_id long, text string"), known).orderBy("line", "nth").collect()]


def test_drift_and_unknown_keys_are_caught(spark, known):
    assert problems(spark, known, "it delivers **99.9%**<!--@YIELD--> of them") == [(1, "YIELD", "99.9%", "mismatch")]
    assert problems(spark, known, "a\nyield 55.6%<!--@YEILD-->") == [(2, "YEILD", None, "unknown figure")]
    assert problems(spark, known, "<!--@YIELD-->") == [(1, "YIELD", "", "mismatch")]


def test_correct_figures_pass_with_decoration(spark, known):
    text = "| **55.6%**<!--@YIELD--> |\nheld (55.6%<!--@YIELD-->) so.\nfell to *55.6%*<!--@YIELD-->, rose; change of **-0.047**<!--@DELTA-->\n| 0.720 ± 0.004<!--@SPREAD--> | 0.111 ± 0.004<!--@SPREAD-->"
    assert [p[3] for p in problems(spark, known, text)] == [None] * 5 + ["mismatch"]


def by_loop(text):
    """All places of distinctive figures outside marked spans and longer numbers, by regular expressions."""
    hidden = [m.span() for m in re.finditer(r"[^<>]*<!--@[A-Z0-9_]+-->", text)]
    least = {}
    for key, value, figure, _ in KNOWN:
        if len(figure) >= 5 and value:
            least[figure] = min(key, least.get(figure, key))
    out = []
    for figure, key in least.items():
        for m in re.finditer(rf"(?=((?<![\d.]){re.escape(figure)}(?!\d)))", text):
            a, b = m.start(), m.start() + len(figure)
            if not any(x < b and a < y for x, y in hidden):
                out.append((key, figure, a, text.count("\n", 0, a) + 1))
    return sorted(out)


@pytest.mark.parametrize("limit", [1 << 20, 150])
def test_unmarked_figures_are_found(spark, known, limit):
    rng = random.Random(5)
    words = [*(k[2] for k in KNOWN), "<!--@YIELD-->", "<!--@TOTAL-->", "<", ">", "\n", " ", "1", ".", ",", "x", "٣"]
    rows = [(i, "".join(rng.choices(words, k=rng.randint(0, 40)))) for i in range(120)] + [(500, None), (501, ""), (502, "55.6% " * 3000)]
    found = figures.unmarked(spark.createDataFrame(rows, "doc_id long, text string"), known, limit=limit).collect()
    want = sorted((i, *x) for i, t in rows for x in by_loop(t or ""))
    assert sorted((r.doc_id, r.key, r.figure, r.at, r.line) for r in found) == want and len(want) > 3100


def test_no_figures(spark, known):
    docs = spark.createDataFrame([("a", "55.6%")], "doc_id string, text string")
    assert figures.unmarked(docs, known.limit(0)).collect() == []
    assert figures.marked(docs, known).collect() == []
    assert [tuple(r) for r in figures.unmarked(docs, known).collect()] == [("a", "YIELD", "55.6%", 0, 1)]


def test_marks_of_a_very_long_text_are_found_in_linear_time():
    automaton = ahocorasick.Automaton()
    automaton.add_word("55.6%", "55.6%")
    automaton.make_automaton()
    text = "no bracket " * 400_000 + "55.6%<!--@YIELD-->" + " 55.6%" * 1000
    assert len(figures.occurrences(text, automaton)) == 1000


# ---------------------------------------------------------------- what is held


@pytest.mark.parametrize("ranges", [1, 5])
@pytest.mark.parametrize("asked", [True, False])
def test_occupancy(spark, ranges, asked):
    rng = random.Random(ranges)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(20) if rng.random() < 0.95 else None, None if rng.random() < 0.3 else rng.randrange(25), float(i)) for i in range(300)]
    items = spark.createDataFrame(rows, "k string, come long, go long, w double")
    points = [(k, d) for k in ("a", "b", None, "none") for d in range(-2, 27)]
    got = occupancy.occupancy(items, ["k"], "come", "go", {"n": "1", "w": "w"}, spark.createDataFrame(points, "k string, at long") if asked else None, ranges).collect()
    held = lambda k, d: [r for r in rows if r[0] == k and r[1] is not None and r[1] <= d and (r[2] is None or r[2] > d)]
    assert {(r.k, r["at"]): (r.n, r.w) for r in got} == {(r.k, r["at"]): (len(held(r.k, r["at"])), sum(x[3] for x in held(r.k, r["at"]))) for r in got}
    if asked:
        assert {(r.k, r["at"]) for r in got} == set(points)


def test_a_group_of_one_day_is_one_row(spark):
    items = spark.range(10_000).select(F.lit("hot").alias("k"), F.lit(3).alias("come"), F.lit(None).cast("int").alias("go"))
    assert [tuple(r) for r in occupancy.occupancy(items, ["k"], "come", "go").collect()] == [("hot", 3, 10_000)]


def test_one_pass_whatever_the_number_of_figures(spark):
    """Many figures of few looks are one pass over the documents, with the rows of the passes by automata."""
    known = spark.createDataFrame([(f"K{i}", float(i + 1), t) for i, t in enumerate([*(f"{i:,}.{i % 90 + 10}" for i in range(1000, 3000)), "3 of 75", "a1234", "12.50%"])], "key string, value double, text string")
    docs = spark.createDataFrame([(1, "1,234.74 a1234 b 3 of 75, 11,234.74 1,234.745\n2,999.39 and .1,234.74 12.50% x12.50%"), (2, None), (3, "1,000.20<!--@K0--> 1,000.201,001.21 \u0661,000.20")], "doc_id long, text string")
    one = figures.unmarked(docs, known, limit=4096)
    assert "Union" not in one._jdf.queryExecution().analyzed().toString()
    automaton = ahocorasick.Automaton()
    for r in known.collect():
        automaton.add_word(r.text, r.text)
    automaton.make_automaton()
    want = sorted((d.doc_id, f, at) for d in docs.collect() if d.text for at, f in figures.occurrences(d.text, automaton))
    assert sorted((r.doc_id, r.figure, r.at) for r in one.collect()) == want and {"1,234.74", "3 of 75", "a1234", "12.50%"} <= {w[1] for w in want}


def test_texts_are_shuffled_once(spark, sf_dir):
    """Whatever is joined to documents for their figures, a text crosses the network once, and no join sorts it."""
    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        for k, v in zip(kept, ("-1", "false"), strict=True):
            spark.conf.set(k, v)
        plan = spark._jvm.PythonSQLUtils.explainString(reports.quoting(spark, sf_dir, reports.figures_of_orders(spark, sf_dir))._jdf.queryExecution(), "formatted")
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    moved = re.findall(r"\) (Exchange|Sort) ?[^\n]*\nInput \[\d+\]: \[([^\]]*)\]", plan)
    assert [kind for kind, columns in moved if "text#" in columns] == ["Exchange"]
