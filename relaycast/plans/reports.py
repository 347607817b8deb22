"""Facts, number validation, published markers."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import facts, figures, ranking
from ..operators import reports as R2
from ..operators import replay as R
from ..session import table
from .missions import BASE, stats_mission
from .registry import MISSION, mission, query


@query(r"""WITH t AS (SELECT page_id, 'Window ' || page_id || ' sent ' || (page_id * 37 % 1000) || ' frames, ' || (page_id % 9) || '.5 percent of 1,' || lpad(CAST(page_id AS VARCHAR), 3, '0') AS text FROM pages),
 x AS (SELECT page_id, replace(unnest(regexp_extract_all(text, '\d+(?:,\d{3})*(?:\.\d+)?')), ',', '') AS number FROM t), d AS (SELECT DISTINCT * FROM x)
 SELECT page_id, number FROM d WHERE number NOT IN (SELECT CAST(n_nationkey AS VARCHAR) FROM nation)""")
def number_extract_antijoin(spark, sf_dir):
    i = F.col("page_id")
    text = F.concat(F.lit("Window "), i, F.lit(" sent "), i * 37 % 1000, F.lit(" frames, "), i % 9, F.lit(".5 percent of 1,"), F.lpad(i.cast("string"), 3, "0"))
    found = table(spark, sf_dir, "pages").select("page_id", F.explode(T.numbers(text)).alias("number"))
    known = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("number"))
    return found.join(known, "number", "left_anti").select("page_id", "number")


@query("""WITH f AS (SELECT n_regionkey AS grp, n_nationkey AS pos, n_nationkey + 1 AS v FROM nation) SELECT a.grp, a.pos AS i, b.pos AS j, round(a.v / CAST(b.v AS DOUBLE), 6) AS ratio, round(b.v / CAST(a.v AS DOUBLE), 6) AS inverse, b.v - a.v AS diff FROM f a JOIN f b ON a.grp = b.grp AND a.pos < b.pos""")
def pairwise_composites(spark, sf_dir):
    f = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("grp"), F.col("n_nationkey").alias("pos"), (F.col("n_nationkey") + 1).alias("v"))
    a, b = f.alias("a"), f.alias("b")
    both = a.join(b, (F.col("a.grp") == F.col("b.grp")) & (F.col("a.pos") < F.col("b.pos")))
    x, y = F.col("a.v").cast("double"), F.col("b.v").cast("double")
    return both.select("a.grp", F.col("a.pos").alias("i"), F.col("b.pos").alias("j"), F.round(x / y, 6).alias("ratio"), F.round(y / x, 6).alias("inverse"), (F.col("b.v") - F.col("a.v")).alias("diff"))


SHOWN = ", ".join(f"format('{{:.{p}f}}', {x})" for p in range(7) for x in ("v", "v * 100"))


@query(f"""WITH n AS (SELECT n_nationkey AS k, n_nationkey * 1000 / 7.0::DOUBLE AS v FROM nation)
 SELECT DISTINCT k, unnest(CASE WHEN v > 1000 THEN list_concat([{SHOWN}], [format('{{:.1f}}', v / 8192), format('{{:.0f}}', v / 8192)]) ELSE [{SHOWN}] END) AS form FROM n""")
def number_forms(spark, sf_dir):
    values = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), (F.col("n_nationkey") * 1000 / 7.0).alias("v"))
    return values.select("k", F.explode(T.number_forms(F.col("v"))).alias("form"))


@query("""WITH f AS (SELECT n_name AS key, (n_nationkey * 3) || ' of 75' AS value FROM nation WHERE n_nationkey < 20), m AS (SELECT n_name AS key, (n_nationkey * 3 + CASE WHEN n_nationkey % 4 = 0 THEN 1 ELSE 0 END) || ' of 75' AS shown, n_nationkey AS lineno FROM nation)
 SELECT lineno, m.key, CASE WHEN value IS NULL THEN 'unknown figure' WHEN shown <> value THEN 'mismatch' END AS problem FROM m LEFT JOIN f USING (key) WHERE value IS NULL OR shown <> value""")
def marker_join_mismatch(spark, sf_dir):
    nation, k = table(spark, sf_dir, "nation"), F.col("n_nationkey")
    figures = nation.filter("n_nationkey < 20").select(F.col("n_name").alias("figure"), F.concat((k * 3).cast("string"), F.lit(" of 75")).alias("value"))
    lines = nation.select(k.alias("lineno"), F.concat(F.lit("we sent (**"), (k * 3 + F.when(k % 4 == 0, 1).otherwise(0)).cast("string"), F.lit(" of 75**)<!--@"), F.col("n_name"), F.lit("-->")).alias("line"))
    shown = lines.select("lineno", F.explode(T.markers(F.col("line"))).alias("m")).select("lineno", F.col("m.key").alias("key"), F.col("m.text").alias("before"))
    joined = shown.join(figures, F.col("key") == F.col("figure"), "left").withColumn("shown", T.last_words(F.col("before"), F.col("value")))
    return joined.filter("value is null or shown <> value").select("lineno", "key", F.when(F.col("value").isNull(), "unknown figure").otherwise("mismatch").alias("problem"))


FIGURES = "figures AS (SELECT 'ORDER_' || o_orderkey AS key, o_totalprice AS value, format('{:,.2f}', o_totalprice) AS text, 'orders/' || o_orderkey AS source FROM orders)"
#: Each document quotes its own order with a mark, wrongly in some, and others' totals without one.
QUOTED = """quoted AS (SELECT d.doc_id, '> in all **' || CASE WHEN doc_id % 5 = 0 THEN '0.01' ELSE f.text END || '**<!--@' || CASE WHEN doc_id % 11 = 0 THEN 'NO_' ELSE '' END || f.key || '-->' || chr(10) || coalesce(d.text, '') || chr(10) || 'beside ' || g.text || ', (' || f.text || ') or 1' || f.text AS text
  FROM documents d JOIN figures f ON f.key = 'ORDER_' || doc_id JOIN figures g ON g.key = 'ORDER_' || (doc_id + 1))"""


def figures_of_orders(spark, sf_dir):
    k = F.col("o_orderkey").cast("string")
    return table(spark, sf_dir, "orders").select(F.concat(F.lit("ORDER_"), k).alias("key"), F.col("o_totalprice").alias("value"), F.format_number("o_totalprice", 2).alias("text"), F.concat(F.lit("orders/"), k).alias("source"))


def quoting(spark, sf_dir, figures):
    """Figures meet identifiers alone; then each text is shuffled once, and streams past the figures of its partition unsorted."""
    own, other = figures.select(F.col("key").alias("k1"), F.col("text").alias("t1")), figures.select(F.col("key").alias("k2"), F.col("text").alias("t2"))
    i, docs = F.col("doc_id"), table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = docs.select("doc_id").distinct().withColumn("k1", F.concat(F.lit("ORDER_"), i)).withColumn("k2", F.concat(F.lit("ORDER_"), i + 1))
    both = docs.join(ids.join(own, "k1").join(other, "k2").hint("shuffle_hash"), "doc_id")
    head = F.concat(F.lit("> in all **"), F.when(i % 5 == 0, "0.01").otherwise(F.col("t1")), F.lit("**<!--@"), F.when(i % 11 == 0, "NO_").otherwise(""), F.col("k1"), F.lit("-->\n"))
    return both.select("doc_id", F.concat(head, F.coalesce("text", F.lit("")), F.lit("\nbeside "), F.col("t2"), F.lit(", ("), F.col("t1"), F.lit(") or 1"), F.col("t1")).alias("text"))


@query(f"""WITH {FIGURES}, {QUOTED} SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'NO_' ELSE '' END || 'ORDER_' || doc_id AS key, CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 5 = 0 THEN '0.01' ELSE f.text END AS written, CASE WHEN doc_id % 11 <> 0 THEN f.text END AS text, CASE WHEN doc_id % 11 <> 0 THEN source END AS source,
  CASE WHEN doc_id % 11 = 0 THEN 'unknown figure' WHEN doc_id % 5 = 0 AND f.text <> '0.01' THEN 'mismatch' END AS problem FROM quoted JOIN figures f ON f.key = 'ORDER_' || doc_id""")
def marked_figures(spark, sf_dir):
    """Every mark in every document against the figure that it names."""
    known = figures_of_orders(spark, sf_dir)
    return figures.marked(quoting(spark, sf_dir, known), known).select("doc_id", "key", "written", "text", "source", "problem")


@query(f"""WITH {FIGURES}, {QUOTED}, wanted AS (SELECT text AS figure, min(key) AS key FROM figures WHERE length(text) >= 5 AND value <> 0 GROUP BY 1),
 lines AS (SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line, unnest(string_split(text, chr(10))) AS line_text FROM quoted),
 runs AS (SELECT doc_id, line, unnest(regexp_extract_all(CASE WHEN line = 1 THEN regexp_replace(line_text, '^.*-->', '') ELSE line_text END, '[0-9.,]+')) AS run FROM lines),
 cuts AS (SELECT doc_id, line, run, unnest(range(1, length(run) + 1)) AS i FROM runs), parts AS (SELECT doc_id, line, run, i, unnest(range(5, length(run) - i + 2)) AS n FROM cuts WHERE length(run) - i >= 4 AND (i = 1 OR run[i - 1] = ','))
 SELECT doc_id, key, figure, CAST(line AS BIGINT) AS line, count(*) AS n FROM parts JOIN wanted ON figure = run[i : i + n - 1] WHERE run[i + n] NOT IN ('0', '1', '2', '3', '4', '5', '6', '7', '8', '9') GROUP BY ALL""")
def unmarked_figures(spark, sf_dir):
    """Every unmarked occurrence of any of thousands of figures in all documents, by line."""
    known = figures_of_orders(spark, sf_dir)
    found = figures.unmarked(quoting(spark, sf_dir, known), known)
    return found.groupBy("doc_id", "key", "figure", "line").agg(F.count("*").alias("n"))


@query("""SELECT n_name, r_name, n_nationkey FROM nation JOIN region ON contains(n_name, CAST(r_regionkey AS VARCHAR))""")
def regex_theta_join(spark, sf_dir):
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.join(F.broadcast(region), F.regexp_like(F.col("n_name"), F.concat(F.lit("\\Q"), F.col("r_regionkey").cast("string"), F.lit("\\E")))).select("n_name", "r_name", "n_nationkey")  # five regions


@query(f"""WITH {MISSION}, a AS (SELECT count(*) AS n, count(*) FILTER (WHERE grp = 'natural') AS nat, sum(bits) AS bits, max(sol) AS last_sol FROM mission)
 SELECT 'frames' AS key, format('{{:,}}', n) AS value, 'frames' AS unit FROM a UNION ALL SELECT 'natural', format('{{:,}}', nat), 'frames' FROM a UNION ALL SELECT 'share', format('{{:.1f}}%', nat * 100.0::DOUBLE / n), 'percent' FROM a UNION ALL SELECT 'volume', format('{{:.1f}} KiB', bits / 8192), 'KiB' FROM a UNION ALL SELECT 'last_sol', CAST(last_sol AS VARCHAR), 'sol' FROM a""")
def facts_unpivot(spark, sf_dir):
    a = mission(spark, sf_dir).agg(F.count("*").alias("n"), F.count_if(F.col("grp") == "natural").alias("nat"), F.sum("bits").alias("bits"), F.max("sol").alias("last_sol"))
    fact = lambda k, v, u: F.struct(F.lit(k).alias("key"), v.alias("value"), F.lit(u).alias("unit"))
    return a.select(
        F.inline(F.array(fact("frames", F.format_number("n", 0), "frames"), fact("natural", F.format_number("nat", 0), "frames"), fact("share", T.percent(F.col("nat").cast("double") / F.col("n")), "percent"), fact("volume", T.kib(F.col("bits")), "KiB"), fact("last_sol", F.col("last_sol").cast("string"), "sol")))
    )


@query(f"""WITH {MISSION}, d AS (SELECT sol, count(*) AS n, count(*) FILTER (WHERE grp = 'natural') AS nat, count(*) FILTER (WHERE score > 150) AS lost FROM mission GROUP BY sol)
 SELECT sol, 'Window ' || sol || ': ' || n || ' arrived' || CASE WHEN nat > 0 THEN ', ' || nat || ' of interest' ELSE '' END || CASE WHEN lost > 0 THEN ', ' || lost || ' lost' ELSE ', none lost' END || '.' AS note FROM d""")
def window_notes(spark, sf_dir):
    d = mission(spark, sf_dir).groupBy("sol").agg(F.count("*").alias("n"), F.count_if(F.col("grp") == "natural").alias("nat"), F.count_if(F.col("score") > 150).alias("lost"))
    s = lambda c: F.col(c).cast("string")
    note = F.concat(F.lit("Window "), s("sol"), F.lit(": "), s("n"), F.lit(" arrived"), F.when(F.col("nat") > 0, F.concat(F.lit(", "), s("nat"), F.lit(" of interest"))).otherwise(""), F.when(F.col("lost") > 0, F.concat(F.lit(", "), s("lost"), F.lit(" lost"))).otherwise(", none lost"), F.lit("."))
    return d.select("sol", note.alias("note"))


@query("""WITH k AS (SELECT DISTINCT l_linenumber AS k FROM lineitem) SELECT string_agg(CAST(k AS VARCHAR), '|' ORDER BY k) AS columns FROM k""")
def k_columns(spark, sf_dir):
    maps = table(spark, sf_dir, "lineitem").select(F.create_map(F.col("l_linenumber").cast("string"), F.col("l_discount")).alias("m"))
    keys = maps.select(F.explode(F.map_keys("m")).alias("k")).distinct().select(F.col("k").cast("long").alias("k"))
    return keys.agg(F.array_join(F.array_sort(F.collect_list("k")).cast("array<string>"), "|").alias("columns"))


#: Parameters: dollars a million tokens read and written, by model.
PRICES = {"small": (0.15, 0.6), "medium": (1.0, 4.0), "large": (3.0, 15.0)}
RATES = ", ".join(f"('{m}', {a}::DOUBLE, {b}::DOUBLE)" for m, (a, b) in PRICES.items())


@query(f"""WITH prices(model, read, written) AS (VALUES {RATES}),
 t AS (SELECT conv_id, turn, role, CAST(ceil(length(coalesce(text, '')) / 4.0) AS BIGINT) AS tokens, CASE conv_id % 3 WHEN 0 THEN 'small' WHEN 1 THEN 'medium' ELSE 'large' END AS model FROM conversations),
 g AS (SELECT *, coalesce(sum(tokens) OVER w, 0) AS prompt, coalesce(max(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER w, 0) AS asked FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 r AS (SELECT model, CASE WHEN asked = 0 THEN 'nothing asked' WHEN tokens = 0 THEN 'empty answer' ELSE 'generated' END AS reason, prompt, tokens FROM g WHERE role = 'assistant')
 SELECT model, reason, count(*) AS n, CAST(sum(CASE WHEN reason = 'generated' THEN prompt ELSE 0 END) AS BIGINT) AS prompt_tokens, CAST(sum(CASE WHEN reason = 'generated' THEN tokens ELSE 0 END) AS BIGINT) AS completion_tokens,
  round(sum(CASE WHEN reason = 'generated' THEN prompt * read + tokens * written ELSE 0 END) / 1000000, 9) AS cost FROM r JOIN prices USING (model) GROUP BY model, reason""")
def usage_totals(spark, sf_dir):
    """Answers by model and by why they count or were skipped; tokens read (all turns before) and written, and their cost."""
    tokens = F.ceil(F.char_length(F.coalesce("text", F.lit(""))) / 4.0).cast("long")
    model = F.when(F.col("conv_id") % 3 == 0, "small").when(F.col("conv_id") % 3 == 1, "medium").otherwise("large")
    before = W.partitionBy("conv_id").orderBy("turn", "role", "tokens").rowsBetween(W.unboundedPreceding, -1)  # a conversation's turns
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", tokens.alias("tokens"), model.alias("model"))
    seen = turns.withColumn("prompt", F.coalesce(F.sum("tokens").over(before), F.lit(0))).withColumn("asked", F.coalesce(F.max((F.col("role") == "user").cast("int")).over(before), F.lit(0)))
    answers = seen.filter("role = 'assistant'").withColumn("reason", F.when(F.col("asked") == 0, "nothing asked").when(F.col("tokens") == 0, "empty answer").otherwise("generated"))
    made = F.col("reason") == "generated"
    read, written = (F.coalesce(*[F.when(F.col("model") == m, F.lit(p[k])) for m, p in PRICES.items()]) for k in (0, 1))
    total = lambda c: F.sum(F.when(made, c).otherwise(0))
    sums = answers.groupBy("model", "reason").agg(F.count("*").alias("n"), total(F.col("prompt")).alias("prompt_tokens"), total(F.col("tokens")).alias("completion_tokens"), F.round(total(F.col("prompt") * read + F.col("tokens") * written) / 1e6, 9).alias("cost"))
    return sums


@query(f"""WITH {MISSION} SELECT user_id, CASE WHEN count(*) FILTER (WHERE score > 100) * 2 > count(*) FILTER (WHERE score > 50) THEN 'cycles' ELSE 'bits' END AS dominant, count(*) FILTER (WHERE score > 100) < 1 AS starved FROM mission GROUP BY user_id""")
def dominant_bound(spark, sf_dir):
    hi, mid = F.count_if(F.col("score") > 100), F.count_if(F.col("score") > 50)
    return mission(spark, sf_dir).groupBy("user_id").agg(F.when(hi * 2 > mid, "cycles").otherwise("bits").alias("dominant"), (hi < 1).alias("starved"))


POLICY_RUNS = [(m, m, BASE) for m in R.POLICIES]


@query()
def window_fact_sheets(spark, sf_dir):
    """Every figure that a note on a window may state, from the log of a real replay of each policy."""
    items = stats_mission(spark, sf_dir)
    total = items.agg(F.count_if(F.col("grp") == "natural").alias("n_natural"))
    log = R.run_all(items, POLICY_RUNS, lists=False).crossJoin(F.broadcast(total))  # one row
    return facts.window_facts(log, F.col("n_natural"))


@query()
def mission_fact_sheets(spark, sf_dir):
    items = stats_mission(spark, sf_dir)
    return facts.mission_facts(*R.logs_and_summaries(items, POLICY_RUNS))


@query()
def mission_advice(spark, sf_dir):
    items = stats_mission(spark, sf_dir)
    return facts.advice(*R.logs_and_summaries(items, POLICY_RUNS))


@query()
def window_note_audit(spark, sf_dir):
    """Notes rendered from placeholders, with the number of figures in each that no fact supports."""
    sheet = facts.window_facts(R.run_all(stats_mission(spark, sf_dir), POLICY_RUNS, lists=False))
    texts = sheet.select("run", "window").distinct().withColumn("text", F.lit("Window {{WINDOW}}, sols {{SOLS}}: {{ARRIVED}} arrived, {{SELECTED}} of {{BUFFERED}} sent, {{CUM_YIELD}} so far."))
    notes = facts.rendered(texts, sheet, ["run", "window"])
    wrong = facts.unsupported(notes, sheet, ["run", "window"]).groupBy("run", "window").agg(F.count("*").alias("n_unsupported"))
    return notes.join(wrong, ["run", "window"], "left").select("run", "window", "text", F.size("unknown").cast("long").alias("n_unknown"), F.coalesce("n_unsupported", F.lit(0)).alias("n_unsupported"))


#: Each (tier, line status) of the line items is a run: lines ranked by price, dear discounts are the ones of interest.
RUNS = """ranked AS (SELECT l_returnflag AS tier, l_linestatus AS seed, CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END AS y, row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY l_extendedprice DESC, CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END, l_orderkey * 10 + l_linenumber) AS rank FROM lineitem),
 sizes AS (SELECT tier, seed, count(*) AS n FROM ranked GROUP BY 1, 2), ks(k) AS (VALUES (10), (25), (50), (162)),
 at_k AS (SELECT tier, seed, k, sum(CASE WHEN rank <= k THEN y ELSE 0 END) / CAST(least(k, any_value(n)) AS DOUBLE) AS value FROM ranked JOIN sizes USING (tier, seed), ks GROUP BY tier, seed, k),
 made AS (SELECT tier, k, count(*) AS n, avg(value) AS mean, stddev_pop(value) AS sd FROM at_k GROUP BY 1, 2)"""


def ranked_runs(spark, sf_dir):
    y = (F.col("l_discount") > 0.05).cast("int")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("tier"), F.col("l_linestatus").alias("seed"), y.alias("y"), F.col("l_extendedprice").alias("s"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("idx"))
    at_k = ranking.precision_at_k(ranking.pessimistic_rank(rows, ["tier", "seed"]), [10, 25, 50, 162], ["tier", "seed"])
    return at_k.withColumnRenamed("precision", "value")


@query(f"""WITH {RUNS} SELECT tier, CAST(k AS BIGINT) AS k, round(mean, 9) AS mean, round(sd, 9) AS sd, n, CASE WHEN n = 1 THEN format('{{:.3f}}', mean) ELSE format('{{:.3f}} ± {{:.3f}}', mean, sd) END AS text,
 'lineitem where tier=' || tier || ' and k=' || k || ': mean of value over ' || n || ' runs' AS source FROM made""")
def figures_with_lineage(spark, sf_dir):
    """Precision of every tier at each k over its runs, as written, with where it comes from."""
    made = R2.figures(ranked_runs(spark, sf_dir), ["tier"], "k", "lineitem")
    return made.select("tier", "k", F.round("mean", 9).alias("mean"), F.round("sd", 9).alias("sd"), "n", "text", "source")


@query(f"""WITH {RUNS}, cells AS (SELECT tier, k, CASE WHEN n = 1 THEN format('{{:.3f}}', mean) ELSE format('{{:.3f}} ± {{:.3f}}', mean, sd) END AS text FROM made),
 body AS (SELECT tier, '| ' || tier || ' | ' || string_agg(text, ' | ' ORDER BY k) || ' |' AS line FROM cells GROUP BY 1),
 whole AS (SELECT 0 AS a, '' AS b, '## Precision at k' AS line UNION ALL SELECT 1, '', '' UNION ALL SELECT 2, '', '| tier | p@10 | p@25 | p@50 | p@162 (window) |' UNION ALL SELECT 3, '', '|---|---|---|---|---|' UNION ALL SELECT 4, tier, line FROM body)
 SELECT row_number() OVER (ORDER BY a, b) - 1 AS line_no, line FROM whole""")
def curve_report(spark, sf_dir):
    """The curve as a document: lines numbered over all sections, a pivot over fixed columns."""
    table_ = R2.wide(R2.figures(ranked_runs(spark, sf_dir), ["tier"], "k", "lineitem"), ["tier"], "k", [10, 25, 50, 162])
    heads = {"tier": "tier", "10": "p@10", "25": "p@25", "50": "p@50", "162": "p@162 (window)"}
    return R2.document([R2.text_lines(spark, ["## Precision at k", ""], 0), R2.table_lines(table_, heads, "tier", section=1)])
