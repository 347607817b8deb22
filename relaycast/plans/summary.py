"""Summaries over runs: demo of methods, hardware profiles, published figures, recommendations, lookups."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import cost as C
from ..functions import text as T
from ..operators import selection as S
from ..session import table, with_workers
from .missions import candidates
from .registry import MISSION, mission, query


@query()
def budget_demo(spark, sf_dir):
    """What three methods send for every user under both budgets, and how much of it is of interest."""
    items = candidates(with_workers(spark), sf_dir)
    wanted = mission(spark, sf_dir).filter("grp = 'natural'").select("idx")
    sent = S.greedy_by_methods(items, ["user_id"], ["random", "score_first", "greedy_sweep"]).select(F.col("_walk").alias("method"), F.explode("selected").alias("idx"))
    both = sent.join(wanted.withColumn("hit", F.lit(1)), "idx", "left")
    return both.groupBy("method").agg(F.count("*").alias("n_sent"), F.round(F.avg(F.coalesce("hit", F.lit(0))), 9).alias("precision"))


@query("""WITH p(tier, per_flop, flops) AS (VALUES ('rad750', 3.0::DOUBLE, 866432), ('myriad', 0.25::DOUBLE, 9428992), ('snapdragon', 0.1::DOUBLE, 49209344)), o AS (SELECT o_orderkey AS run, CASE o_orderkey % 4 WHEN 0 THEN 'rad750' WHEN 1 THEN 'myriad' WHEN 2 THEN 'snapdragon' ELSE 'none' END AS hardware FROM orders)
 SELECT hardware, count(*) AS n, max(per_flop * 866432) AS cycles FROM o LEFT JOIN p ON tier = hardware GROUP BY hardware""")
def hardware_profile(spark, sf_dir):
    profiles = spark.createDataFrame([*C.CYCLES_PER_FLOP.items()], "hardware string, per_flop double")
    k = F.col("o_orderkey") % 4
    runs = table(spark, sf_dir, "orders").select(F.when(k == 0, "rad750").when(k == 1, "myriad").when(k == 2, "snapdragon").otherwise("none").alias("hardware"))
    return runs.join(F.broadcast(profiles), "hardware", "left").groupBy("hardware").agg(F.count("*").alias("n"), F.max(F.col("per_flop") * 866_432).alias("cycles"))  # three profiles


@query("""SELECT o_custkey AS run, o_orderkey AS artifact FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r = 1""")
def preferred_variant(spark, sf_dir):
    rank = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    best = F.min(F.struct(rank.alias("k"), (-F.col("o_totalprice")).alias("p"), F.col("o_orderkey").alias("artifact")))
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("run")).agg(best.alias("b")).select("run", "b.artifact")


@query("""SELECT o_orderkey AS artifact, sha256(CAST(o_orderkey AS VARCHAR)) AS content_sha256, l.n FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) l ON l.l_orderkey = o_orderkey""")
def sidecar_join(spark, sf_dir):
    metrics = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("artifact")).agg(F.count("*").alias("n"))
    cards = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("artifact"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("content_sha256"))
    return cards.join(metrics, "artifact", "left").select("artifact", "content_sha256", "n")


@query(f"""WITH {MISSION}, u AS (SELECT user_id, count(*) AS n, count(*) FILTER (WHERE score > 100) AS expired, sum(CASE WHEN grp = 'rover' THEN bits ELSE 0 END) / sum(bits) AS wasted, count(*) FILTER (WHERE score > 150) AS starved FROM mission GROUP BY user_id)
 SELECT user_id, trim(CASE WHEN wasted > 0.10 THEN 'Tighten the screen: too much of the volume is unwanted. ' ELSE '' END || CASE WHEN starved > 0 THEN 'Raise the compute budget. ' ELSE '' END || CASE WHEN expired > 2 THEN 'Lengthen retention: ' || expired || ' items expired. ' ELSE '' END || CASE WHEN wasted <= 0.10 AND starved = 0 AND expired <= 2 THEN 'No change.' ELSE '' END) AS advice FROM u""")
def recommendations(spark, sf_dir):
    u = mission(spark, sf_dir).groupBy("user_id").agg(F.count_if(F.col("score") > 100).alias("expired"), (F.sum(F.when(F.col("grp") == "rover", F.col("bits")).otherwise(0.0)) / F.sum("bits")).alias("wasted"), F.count_if(F.col("score") > 150).alias("starved"))
    w, s, e = F.col("wasted") > 0.10, F.col("starved") > 0, F.col("expired") > 2
    parts = [F.when(w, "Tighten the screen: too much of the volume is unwanted. ").otherwise(""), F.when(s, "Raise the compute budget. ").otherwise(""), F.when(e, F.concat(F.lit("Lengthen retention: "), F.col("expired").cast("string"), F.lit(" items expired. "))).otherwise(""), F.when(~w & ~s & ~e, "No change.").otherwise("")]
    return u.select("user_id", F.trim(F.concat(*parts)).alias("advice"))


@query("""WITH g AS (SELECT l_returnflag AS tier, l_linestatus AS seed, avg(l_discount) AS m, count(*) AS n FROM lineitem GROUP BY 1, 2), t AS (SELECT tier, avg(m) AS mean, stddev_pop(m) AS sd, sum(n) AS n FROM g GROUP BY tier)
 SELECT tier || '.mean' AS key, format('{:.3f} ± {:.3f}', mean, sd) AS text FROM t UNION ALL SELECT tier || '.rows', format('{:,}', CAST(n AS BIGINT)) FROM t""")
def published_figures(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("tier"), "l_linestatus").agg(F.avg("l_discount").alias("m"), F.count("*").alias("n"))
    t = g.groupBy("tier").agg(F.avg("m").alias("mean"), F.stddev_pop("m").alias("sd"), F.sum("n").alias("n"))
    return t.select(F.inline(F.array(F.struct(F.concat("tier", F.lit(".mean")).alias("key"), T.mean_sd(F.col("mean"), F.col("sd")).alias("text")), F.struct(F.concat("tier", F.lit(".rows")).alias("key"), F.format_number("n", 0).alias("text")))))


@query(f"""WITH {MISSION}, y AS (SELECT user_id, count(*) FILTER (WHERE grp = 'natural' AND score > 40) AS got, count(*) FILTER (WHERE grp = 'natural' AND idx % 3 = 0) AS fifo, count(*) FILTER (WHERE grp = 'natural') AS best FROM mission GROUP BY user_id)
 SELECT user_id, CASE WHEN best > 0 THEN round(got / CAST(best AS DOUBLE), 9) END AS of_ceiling, CASE WHEN best > fifo THEN round((got - fifo) / CAST(best - fifo AS DOUBLE), 9) END AS of_gap FROM y""")
def ceiling_ratios(spark, sf_dir):
    natural = F.col("grp") == "natural"
    y = mission(spark, sf_dir).groupBy("user_id").agg(F.count_if(natural & (F.col("score") > 40)).alias("got"), F.count_if(natural & (F.col("idx") % 3 == 0)).alias("fifo"), F.count_if(natural).alias("best"))
    return y.select("user_id", F.round(C.ratio(F.col("got"), F.col("best"), None), 9).alias("of_ceiling"), F.when(F.col("best") > F.col("fifo"), F.round(C.ratio(F.col("got") - F.col("fifo"), F.col("best") - F.col("fifo"), None), 9)).alias("of_gap"))


@query(f"""WITH {MISSION} SELECT sol, idx FROM (SELECT sol, idx, row_number() OVER (PARTITION BY sol ORDER BY idx DESC) AS r FROM mission) WHERE r <= 20""")
def latest_per_window(spark, sf_dir):
    w = W.partitionBy("sol").orderBy(F.desc("idx"))
    return mission(spark, sf_dir).withColumn("r", F.row_number().over(w)).filter("r <= 20").select("sol", "idx")  # the last twenty of each window are the query


@query(f"WITH {MISSION} SELECT idx FROM (SELECT DISTINCT idx FROM mission WHERE score > 20 EXCEPT SELECT DISTINCT idx FROM mission WHERE score > 60)")
def never_scored(spark, sf_dir):
    items = mission(spark, sf_dir)
    return items.filter("score > 20").select("idx").distinct().join(items.filter("score > 60").select("idx"), "idx", "left_anti")
