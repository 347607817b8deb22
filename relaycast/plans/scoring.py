"""Ranking metrics, cost model, vector operators, evaluation roll-ups."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import cost as C
from ..functions import vectors as V
from ..operators import quantiles
from ..operators import ranking as K
from ..session import stored, table
from .registry import MISSION, longs, mission, query

RANKED = """r AS (SELECT event_id AS idx, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS y, value AS s FROM events),
  k AS (SELECT *, row_number() OVER (ORDER BY s DESC, y, idx) AS rank FROM r)"""
KS = [1, 10, 50, 162, 100_000_000]


def scored(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("idx"), (F.col("event_type") == "purchase").cast("int").alias("y"), F.col("value").alias("s"))


@query(f"WITH {RANKED}, n AS (SELECT count(*) AS n FROM r), ks(k) AS (VALUES {', '.join(f'({k})' for k in KS)}) SELECT CAST(ks.k AS BIGINT) AS k, sum(CASE WHEN rank <= ks.k THEN y END) / CAST(least(ks.k, max(n)) AS DOUBLE) AS precision FROM k, n, ks GROUP BY ks.k")
def precision_at_k(spark, sf_dir):
    return K.precision_at_k(K.pessimistic_rank(K.validated(scored(spark, sf_dir))), KS)


@query(f"WITH {RANKED}, ks(k) AS (VALUES {', '.join(f'({k})' for k in KS)}) SELECT CAST(ks.k AS BIGINT) AS k, sum(CASE WHEN rank <= ks.k THEN y END) / CAST(sum(y) AS DOUBLE) AS recall FROM k, ks GROUP BY ks.k")
def recall_at_k(spark, sf_dir):
    return K.recall_at_k(K.pessimistic_rank(scored(spark, sf_dir)), KS)


@query(f"WITH {RANKED}, c AS (SELECT *, sum(y) OVER (ORDER BY rank) AS tp FROM k) SELECT round(sum(tp / CAST(rank AS DOUBLE) * y) / sum(y), 9) AS average_precision FROM c")
def average_precision(spark, sf_dir):
    return K.average_precision(K.pessimistic_rank(scored(spark, sf_dir))).select(F.round("average_precision", 9).alias("average_precision"))


BUNDLE = [10, 25, 50, 100]


@query(f"""WITH {RANKED}, c AS (SELECT *, sum(y) OVER (ORDER BY rank) AS tp FROM k), m AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS mid FROM r),
 a AS (SELECT round((sum(mid * y) - sum(y) * (sum(y) + 1) / 2.0) / (CAST(sum(y) AS DOUBLE) * (count(*) - sum(y))), 9) AS roc_auc FROM m)
 SELECT CAST(count(*) - sum(y) AS BIGINT) AS n_typical, CAST(sum(y) AS BIGINT) AS n_novel, round(avg(y), 9) AS novel_rate, round(sum(tp / CAST(rank AS DOUBLE) * y) / sum(y), 9) AS average_precision, any_value(roc_auc) AS roc_auc,
  {", ".join(f"round(sum(CASE WHEN rank <= {k} THEN y ELSE 0 END) / CAST(least({k}, count(*)) AS DOUBLE), 9) AS p_{k}, round(sum(CASE WHEN rank <= {k} THEN y ELSE 0 END) / CAST(sum(y) AS DOUBLE), 9) AS r_{k}" for k in BUNDLE)} FROM c, a""")
def metric_bundle(spark, sf_dir):
    b = K.metric_bundle(K.validated(scored(spark, sf_dir)), BUNDLE)
    at = [F.round(F.element_at(m, F.lit(k).cast("long")), 9).alias(f"{c}_{k}") for k in BUNDLE for c, m in (("p", "precision_at_k"), ("r", "recall_at_k"))]
    return b.select("n_typical", "n_novel", *(F.round(c, 9).alias(c) for c in ("novel_rate", "average_precision", "roc_auc")), *at)


AUC = "(sum(mid * y) - sum(y) * (sum(y) + 1) / 2.0) / (CAST(sum(y) AS DOUBLE) * (count(*) - sum(y)))"


@query(f"WITH {RANKED}, m AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS mid FROM r) SELECT round({AUC}, 9) AS roc_auc, CAST(sum(y) AS BIGINT) AS n_pos, CAST(count(*) - sum(y) AS BIGINT) AS n_neg FROM m")
def roc_auc_midrank(spark, sf_dir):
    return K.roc_auc(K.validated(scored(spark, sf_dir))).withColumn("roc_auc", F.round("roc_auc", 9))


@query(f"""WITH b AS (SELECT event_type AS class, value AS s FROM events), t AS (SELECT s FROM b WHERE class IN ('view', 'click')),
 u AS (SELECT c.class, s, 0 AS y FROM t, (SELECT DISTINCT class FROM b WHERE class NOT IN ('view', 'click')) c UNION ALL SELECT class, s, 1 FROM b WHERE class NOT IN ('view', 'click')),
 m AS (SELECT class, y, rank() OVER (PARTITION BY class ORDER BY s) + (count(*) OVER (PARTITION BY class, s) - 1) / 2.0 AS mid FROM u) SELECT class, round({AUC}, 9) AS roc_auc, CAST(sum(y) AS BIGINT) AS n FROM m GROUP BY class""")
def per_class_auc(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("class"), F.col("value").alias("s"))
    typical = F.col("class").isin("view", "click")
    return K.auc_against(rows.filter(typical).select("s"), rows.filter(~typical), "class").withColumn("roc_auc", F.round("roc_auc", 9))


@query(f"""WITH {MISSION}, m AS (SELECT grp, y, rank() OVER (PARTITION BY grp ORDER BY s) + (count(*) OVER (PARTITION BY grp, s) - 1) / 2.0 AS mid FROM (
  SELECT g.grp, score AS s, 0 AS y FROM mission, (VALUES ('natural'), ('rover'), ('excluded')) g(grp) WHERE mission.grp = 'typical' UNION ALL SELECT grp, score, 1 FROM mission WHERE grp <> 'typical'))
  SELECT grp, round({AUC}, 9) AS roc_auc, CAST(sum(y) AS BIGINT) AS n FROM m GROUP BY grp""")
def group_auc(spark, sf_dir):
    rows = mission(spark, sf_dir).select("grp", F.col("score").alias("s"))
    return K.auc_against(rows.filter("grp = 'typical'").select("s"), rows.filter("grp <> 'typical'"), "grp").withColumn("roc_auc", F.round("roc_auc", 9))


@query("""SELECT avg(value) FILTER (WHERE event_type <> 'purchase') > 0 AS has_typical, round(stddev_pop(value), 6) AS sd, round(avg(value), 6) AS mean, CAST(count(*) FILTER (WHERE event_type = 'purchase') AS DOUBLE) / count(*) AS novel_rate FROM events""")
def score_summary(spark, sf_dir):
    e = scored(spark, sf_dir)
    return e.agg((F.avg(F.when(F.col("y") == 0, F.col("s"))) > 0).alias("has_typical"), F.round(F.stddev_pop("s"), 6).alias("sd"), F.round(F.avg("s"), 6).alias("mean"), (F.sum("y").cast("double") / F.count("*")).alias("novel_rate"))


@query("""WITH t(tier, flops) AS (VALUES ('rad750', 866432), ('myriad', 9428992), ('snapdragon', 49209344)), h(hardware, rate) AS (VALUES ('rad750', 3.0::DOUBLE), ('myriad', 0.25::DOUBLE), ('snapdragon', 0.1::DOUBLE)), f AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1)
  SELECT label, tier, hardware, n, flops * n AS flops, round(flops * n * rate, 3) AS cycles, flops * rate <= 20000000 AS fits, CAST(floor(20000000 / (flops * rate)) AS BIGINT) AS affordable, round(flops * n * rate / 20000000, 9) AS windows FROM f, t, h""")
def cost_model(spark, sf_dir):
    """What scoring each class's frames costs by model and processor, and how many fit in a window."""
    counts = table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("n"))
    tiers = [F.struct(F.lit(t).alias("tier"), F.lit(f).cast("long").alias("one")) for t, f in (("rad750", C.pca_flops()), ("myriad", 9428992), ("snapdragon", 49209344))]
    hw = [F.struct(F.lit(k).alias("hardware"), F.lit(v).alias("rate")) for k, v in C.CYCLES_PER_FLOP.items()]
    each = counts.select("*", F.inline(F.array(*tiers))).select("*", F.inline(F.array(*hw)))
    one, flops = F.col("one") * F.col("rate"), F.col("one") * F.col("n")
    return each.select("label", "tier", "hardware", "n", flops.alias("flops"), F.round(flops * F.col("rate"), 3).alias("cycles"), (one <= 20_000_000).alias("fits"), F.floor(20_000_000 / one).alias("affordable"), F.round(flops * F.col("rate") / 20_000_000, 9).alias("windows"))


SIDE = 4
EMB = "e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS p FROM embeddings)"


def frames(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", V.doubles(F.col("embedding")).alias("p"))


@query(f"""WITH {EMB}, o AS (SELECT vec_id, unnest(range(16)) AS i, p FROM e)
  SELECT vec_id, list(round((p[((i//8)*2*4 + ((i//4)%2)*2)*4 + i%4 + 1] + p[((i//8)*2*4 + ((i//4)%2)*2 + 1)*4 + i%4 + 1] + p[(((i//8)*2+1)*4 + ((i//4)%2)*2)*4 + i%4 + 1] + p[(((i//8)*2+1)*4 + ((i//4)%2)*2 + 1)*4 + i%4 + 1]) / 4, 6) ORDER BY i) AS p FROM o GROUP BY vec_id""")
def block_downsample(spark, sf_dir):
    small = V.block_downsample(F.col("p"), SIDE, SIDE, SIDE, 2)
    return frames(spark, sf_dir).select("vec_id", F.transform(small, lambda x: V.rounded(x, 6)).alias("p"))


@query(f"""WITH {EMB}, x AS (SELECT (i % 4) AS band, p[i + 1] AS v FROM e, (SELECT unnest(range(64)) AS i)) SELECT CAST(band AS BIGINT) AS band, round(avg(v), 8) AS mean, round(CASE WHEN sqrt(greatest(avg(v*v) - avg(v)*avg(v), 0)) < 1e-6 THEN 1 ELSE sqrt(greatest(avg(v*v) - avg(v)*avg(v), 0)) END, 8) AS std FROM x GROUP BY band""")
def band_statistics(spark, sf_dir):
    each = frames(spark, sf_dir).select(F.posexplode("p").alias("i", "v"))
    sd = F.sqrt(F.greatest(F.avg(F.col("v") * F.col("v")) - F.avg("v") * F.avg("v"), F.lit(0.0)))
    return each.groupBy((F.col("i") % 4).cast("long").alias("band")).agg(F.round(F.avg("v"), 8).alias("mean"), F.round(F.when(sd < 1e-6, 1.0).otherwise(sd), 8).alias("std"))


@query(f"""WITH {EMB}, x AS (SELECT vec_id, (i % 4) AS band, p[i + 1] AS v FROM e, (SELECT unnest(range(64)) AS i)), s AS (SELECT band, avg(v) AS m, stddev_pop(v) AS sd FROM x GROUP BY band)
  SELECT vec_id, round(sum(abs((v - m) / sd)), 5) AS norm1 FROM x JOIN s USING (band) GROUP BY vec_id""")
def band_standardise(spark, sf_dir):
    data = frames(spark, sf_dir)
    stats = data.select(F.posexplode("p").alias("i", "v")).groupBy((F.col("i") % 4).alias("band")).agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("sd")).agg(F.array_sort(F.collect_list(F.struct("band", "m", "sd"))).alias("bands"))
    both = data.crossJoin(F.broadcast(stats))  # one row of four bands
    scaled = F.transform("p", lambda x, i: (x - F.get("bands", i % 4).m) / F.get("bands", i % 4).sd)
    return both.select("vec_id", F.round(V.total(F.transform(scaled, F.abs)), 5).alias("norm1"))


@query(f"""WITH {EMB}, x AS (SELECT vec_id, (i % 4) AS band, p[i + 1] AS v FROM e, (SELECT unnest(range(64)) AS i)), b AS (SELECT vec_id, band, avg(v) AS m FROM x GROUP BY 1, 2)
  SELECT vec_id, round((SELECT var_pop(v) FROM x WHERE x.vec_id = e.vec_id), 8) AS pixel_variance, round((SELECT var_pop(m) FROM b WHERE b.vec_id = e.vec_id), 8) AS band_variance FROM e""")
def frame_stats(spark, sf_dir):
    return frames(spark, sf_dir).select("vec_id", F.round(V.population_variance(F.col("p")), 8).alias("pixel_variance"), F.round(V.population_variance(V.band_means(F.col("p"), 4)), 8).alias("band_variance"))


@query(f"""WITH {EMB}, h AS (SELECT vec_id, sum(abs(p[(y*4 + x + 1)*4 + c + 1] - p[(y*4 + x)*4 + c + 1])) / 48 AS g FROM e, (SELECT unnest(range(4)) AS y), (SELECT unnest(range(3)) AS x), (SELECT unnest(range(4)) AS c) GROUP BY vec_id),
  v AS (SELECT vec_id, sum(abs(p[((y+1)*4 + x)*4 + c + 1] - p[(y*4 + x)*4 + c + 1])) / 48 AS g FROM e, (SELECT unnest(range(3)) AS y), (SELECT unnest(range(4)) AS x), (SELECT unnest(range(4)) AS c) GROUP BY vec_id),
  t AS (SELECT vec_id, h.g + v.g AS g FROM h JOIN v USING (vec_id)), m AS (SELECT median(g) AS m FROM t)
  SELECT vec_id, round(128.0::DOUBLE * CASE WHEN m > 0 THEN least(4, greatest(0.25, sqrt(g / m))) ELSE 1 END, 5) AS bits FROM t, m""")
def texture_bits_median(spark, sf_dir):
    graded = frames(spark, sf_dir).select("vec_id", V.gradient(F.col("p"), SIDE, SIDE, SIDE).alias("g"))
    graded = stored(graded, "gradients")
    return graded.select("vec_id", F.round(C.texture_bits(F.col("g"), F.lit(quantiles.median(graded, "g")), C.frame_bits(F.lit(64))), 5).alias("bits"))


@query("""WITH e AS (SELECT unnest([0, 25, 50, 75, 100]) AS pct, n FROM (SELECT count(value) AS n FROM events)), o AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS k FROM events WHERE value IS NOT NULL)
  SELECT CAST(pct AS BIGINT) AS percent, value FROM e JOIN o ON k = pct * (n - 1) // 100""")
def exact_percentiles(spark, sf_dir):
    """Values at fixed places of the whole order, by histograms."""
    rows = table(spark, sf_dir, "events").select("value")
    n = rows.filter("value is not null").count()
    return spark.createDataFrame([(p, quantiles.kth(rows, "value", p * (n - 1) // 100)) for p in (0, 25, 50, 75, 100)] if n else [], "percent long, value double")


@query(f"""WITH {EMB}, m AS (SELECT list(a ORDER BY i) AS mu FROM (SELECT i, avg(p[i + 1]) AS a FROM e, (SELECT unnest(range(64)) AS i) GROUP BY i)), c AS (SELECT vec_id, list_transform(range(1, 65), lambda i: p[i] - mu[i]) AS d FROM e, m),
  n AS (SELECT vec_id, list_sum(list_transform(d, lambda x: x*x)) AS total, list_sum(list_transform(d[1:4], lambda x: x*x)) AS kept FROM c)
  SELECT vec_id, round(sqrt(greatest(total - kept, 0)), 6) AS recon_l2, round(greatest(total - kept, 0) / 64, 8) AS recon_mse, round(CASE WHEN total > 0 THEN sqrt(greatest(total - kept, 0) / total) ELSE 0 END, 6) AS recon_normalized, round(kept, 6) AS projected FROM n""")
def axis_residual_scores(spark, sf_dir):
    data = frames(spark, sf_dir)
    mean = data.select(F.posexplode("p").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("a")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "a"))), lambda x: x.a).alias("mu"))
    centred = data.crossJoin(F.broadcast(mean)).select("vec_id", F.zip_with("p", "mu", lambda x, m: x - m).alias("d"))  # one row of 64 numbers
    basis = [[1.0 if i == k else 0.0 for i in range(64)] for k in range(4)]
    got = centred.select("vec_id", V.residuals(F.col("d"), basis).alias("res"), V.dot(F.col("d"), F.col("d")).alias("total"))
    return got.select("vec_id", F.round(F.sqrt("res"), 6).alias("recon_l2"), F.round(F.col("res") / 64, 8).alias("recon_mse"), F.round(F.when(F.col("total") > 0, F.sqrt(F.col("res") / F.col("total"))).otherwise(0.0), 6).alias("recon_normalized"), F.round(F.col("total") - F.col("res"), 6).alias("projected"))


SEEDS = "g AS (SELECT l_returnflag AS tier, l_linestatus AS seed, avg(l_discount) AS m FROM lineitem GROUP BY 1, 2)"


def seeds(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("tier"), F.col("l_linestatus").alias("seed")).agg(F.avg("l_discount").alias("m"))


@query(f"WITH {SEEDS} SELECT tier, round(avg(m), 8) AS mean, round(stddev_pop(m), 8) AS sd, round(max(m), 8) AS best, count(*) AS n FROM g GROUP BY tier")
def seed_mean_sd_pop(spark, sf_dir):
    return seeds(spark, sf_dir).groupBy("tier").agg(F.round(F.avg("m"), 8).alias("mean"), F.round(F.stddev_pop("m"), 8).alias("sd"), F.round(F.max("m"), 8).alias("best"), F.count("*").alias("n"))


@query(f"WITH {SEEDS} SELECT tier, round(avg(m), 8) AS mean, round(stddev_samp(m), 8) AS sd, count(*) AS n FROM g GROUP BY tier HAVING count(*) >= 2")
def seed_mean_sd_samp(spark, sf_dir):
    return seeds(spark, sf_dir).groupBy("tier").agg(F.round(F.avg("m"), 8).alias("mean"), F.round(F.stddev_samp("m"), 8).alias("sd"), F.count("*").alias("n")).filter("n >= 2")


@query("""WITH t AS (SELECT l_returnflag AS tier, CAST(l_linenumber AS BIGINT) AS method, avg(l_discount) AS y FROM lineitem WHERE l_linenumber <> 7 GROUP BY 1, 2) SELECT tier, method FROM (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY round(y, 10) DESC, method) AS r FROM t) WHERE r = 1""")
def best_policy_argmax(spark, sf_dir):
    by = table(spark, sf_dir, "lineitem").filter("l_linenumber <> 7").groupBy(F.col("l_returnflag").alias("tier"), F.col("l_linenumber").cast("long").alias("method")).agg(F.round(F.avg("l_discount"), 10).alias("y"))
    return by.groupBy("tier").agg(F.min_by("method", F.struct((-F.col("y")).alias("y"), F.col("method").alias("m"))).alias("method"))


@query("SELECT arg_max(o_orderkey, o_totalprice * 1e7 + o_orderkey / 1e3) AS run FROM orders")
def latest_run_argmax(spark, sf_dir):
    return table(spark, sf_dir, "orders").agg(F.max_by("o_orderkey", F.col("o_totalprice") * 1e7 + F.col("o_orderkey") / 1e3).alias("run"))


@query("SELECT min(m) AS low, max(m) AS high FROM (SELECT round(avg(l_discount), 8) AS m FROM lineitem GROUP BY l_returnflag)")
def tier_band(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(F.avg("l_discount"), 8).alias("m")).agg(F.min("m").alias("low"), F.max("m").alias("high"))
