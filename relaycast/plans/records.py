"""Records of runs and frames: joins by position, renamed projections, sweeps and their summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators.numbering import numbered
from ..session import shared_path, table
from ..sources import manifests, tensors
from .registry import MISSION, mission, query


@query("SELECT vec_id, label, lang, len(embedding) AS n_values FROM embeddings JOIN documents ON doc_id = vec_id")
def tensor_manifest_join(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "lang")
    return table(spark, sf_dir, "embeddings").join(rows, "vec_id").select("vec_id", "label", "lang", F.size("embedding").cast("long").alias("n_values"))


@query("""SELECT row_number() OVER (ORDER BY vec_id) - 1 AS idx, vec_id, label, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) / 64, 6) AS score FROM embeddings""")
def score_row_zip(spark, sf_dir):
    """Rows of a table paired by position with scores of the array file that was written from them; an unpaired row of either side fails."""
    rows = table(spark, sf_dir, "embeddings")
    path = shared_path(spark, "scored") + ".npy"
    tensors.write_array(rows.select("vec_id", F.col("embedding").alias("values")), path, (64,), "vec_id")
    scores = tensors.read_tensors(spark, path).select(F.lit("all").alias("split"), "index", (V.total(V.doubles(F.col("values"))) / 64).alias("score"))
    manifest = numbered(rows.select("vec_id", "label"), "vec_id", name="index").withColumn("split", F.lit("all"))
    return manifests.load_split(manifest, scores, "all").select(F.col("index").alias("idx"), "vec_id", "label", F.round("score", 6).alias("score"))


@query(f"""WITH {MISSION}, asked AS (SELECT l_orderkey * 10 + l_linenumber AS ordinal, l_partkey AS idx FROM lineitem) SELECT ordinal, idx, score FROM asked JOIN mission USING (idx)""")
def gather_in_caller_order(spark, sf_dir):
    asked = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ordinal"), F.col("l_partkey").alias("idx"))
    return asked.join(mission(spark, sf_dir).select("idx", "score"), "idx").select("ordinal", "idx", "score").orderBy("ordinal")


@query("SELECT o_custkey AS sweep, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_ok, count(*) FILTER (WHERE o_orderstatus = 'P') AS n_not_implemented, count(*) FILTER (WHERE o_orderstatus NOT IN ('F', 'P')) AS n_failed FROM orders GROUP BY 1")
def status_counts(spark, sf_dir):
    s = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("sweep")).agg(F.count_if(s == "F").alias("n_ok"), F.count_if(s == "P").alias("n_not_implemented"), F.count_if(~s.isin("F", "P")).alias("n_failed"))


@query(f"WITH {MISSION} SELECT idx AS i, sol AS s, round_even(CAST(floor(score * 1000) / 1000 AS DECIMAL(18, 3)), 1)::DOUBLE AS v, CAST(bits AS BIGINT) AS b FROM mission")
def short_key_projection(spark, sf_dir):
    v = F.bround((F.floor(F.col("score") * 1000) / 1000).cast("decimal(18,3)"), 1).cast("double")
    return mission(spark, sf_dir).select(F.col("idx").alias("i"), F.col("sol").alias("s"), v.alias("v"), F.col("bits").cast("long").alias("b"))


@query(f"""WITH {MISSION}, w AS (SELECT user_id, min(sol) AS first_sol, max(sol) AS last_sol FROM mission GROUP BY 1)
 SELECT c_custkey AS "window", coalesce(first_sol, -1) AS first_sol, coalesce(last_sol, -1) AS last_sol FROM customer LEFT JOIN w ON w.user_id = c_custkey""")
def window_days_default(spark, sf_dir):
    w = mission(spark, sf_dir).groupBy(F.col("user_id").alias("window")).agg(F.min("sol").alias("first_sol"), F.max("sol").alias("last_sol"))
    both = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("window")).join(w, "window", "left")
    return both.select("window", *(F.coalesce(c, F.lit(-1)).alias(c) for c in ("first_sol", "last_sol")))


@query("SELECT t.tier, s.seed FROM (SELECT DISTINCT l_returnflag AS tier FROM lineitem) t, (SELECT DISTINCT l_linenumber AS seed FROM lineitem) s")
def tier_seed_matrix(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(F.col("l_returnflag").alias("tier")).distinct().crossJoin(rows.select(F.col("l_linenumber").alias("seed")).distinct())  # two short axes


@query("""SELECT l_returnflag AS tier, count(*) AS n, round(avg(l_quantity), 6) AS mean, round(stddev_pop(l_quantity), 6) AS sd, max(l_quantity) AS most FROM lineitem GROUP BY 1""")
def tier_summary(spark, sf_dir):
    q = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("tier")).agg(F.count("*").alias("n"), F.round(F.avg(q), 6).alias("mean"), F.round(F.stddev_pop(q), 6).alias("sd"), F.max(q).alias("most"))


@query(f"WITH {MISSION} SELECT idx, class NOT IN ('view', 'click') AS is_novel, grp = 'natural' AS is_natural, grp = 'rover' AS is_rover FROM mission")
def frame_predicates(spark, sf_dir):
    g = F.col("grp")
    return mission(spark, sf_dir).select("idx", (~F.col("class").isin("view", "click")).alias("is_novel"), (g == "natural").alias("is_natural"), (g == "rover").alias("is_rover"))


@query(f"""WITH {MISSION}, l AS (SELECT user_id, count(*) AS n, sum(bits) AS cost FROM mission GROUP BY 1) SELECT user_id, row_number() OVER (ORDER BY cost DESC, user_id) AS place FROM l""")
def longest_lane_first(spark, sf_dir):
    cost = mission(spark, sf_dir).groupBy("user_id").agg(F.sum("bits").alias("cost"))
    return numbered(cost, F.desc("cost"), "user_id", start=1).select("user_id", "place")
