"""Models' costs and scores, pictures, report tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import images
from ..operators import models, ranking, training
from ..session import table, with_workers
from ..sources import records
from .registry import MISSION, mission, query
from .scoring import AUC, frames


@query("SELECT model, label, flops * count(*) AS flops FROM (VALUES ('conv_ae_myriad', CAST(9428992 AS BIGINT)), ('conv_ae_snapdragon', CAST(49209344 AS BIGINT))) t(model, flops), embeddings GROUP BY model, label, flops")
def autoencoder_flops(spark, sf_dir):
    """Operations that each autoencoder needs for every class's frames."""
    one = [F.struct(F.lit(m).alias("model"), F.lit(models.build(m).flops_per_inference()).cast("long").alias("one")) for m in models.available() if m.startswith("conv")]
    counts = table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("n"))
    return counts.select("label", "n", F.inline(F.array(*one))).select("model", "label", (F.col("one") * F.col("n")).alias("flops"))


@query()
def autoencoder_scores(spark, sf_dir):
    """Every frame scored by an autoencoder that was fitted to the classes taken as typical."""
    data = frames(with_workers(spark), sf_dir)
    fitted = training.fit(data.filter("label < 5"), "vec_id", "p", models.ConvAutoencoder(4, 1, 8, (4, 4, 4)), training.Fit(rounds=3, steps=2))
    return models.score_frames(data, "vec_id", "p", fitted, (4, 4, 4)).withColumn("score", F.round("score", 6))


@query()
def frame_atlas(spark, sf_dir):
    sheets = images.atlas(frames(with_workers(spark), sf_dir), "vec_id", "p", (4, 4, 4), 4)
    return sheets.select("sheet", "n", F.length("png").cast("long").alias("n_bytes"), F.sha2("png", 256).alias("png_sha256"))


@query("SELECT vec_id, CAST(vec_id % 32 AS BIGINT) AS x, CAST(vec_id // 32 AS BIGINT) AS y FROM embeddings")
def tile_places(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", images.tile_place(F.col("vec_id")).alias("t")).select("vec_id", F.col("t.x").cast("long").alias("x"), F.col("t.y").cast("long").alias("y"))


@query(f"""WITH {MISSION}, r AS (SELECT grp, count(*) AS n, CAST(sum(bits) AS BIGINT) AS bits FROM mission GROUP BY grp), o AS (SELECT *, row_number() OVER (ORDER BY grp) + 1 AS k FROM r)
 SELECT CAST(k AS INTEGER) AS line_no, '| ' || grp || ' | ' || n || ' | ' || bits || ' |' AS line FROM o UNION ALL SELECT 0, '| grp | n | bits |' UNION ALL SELECT 1, '|---|---|---|'""")
def markdown_table(spark, sf_dir):
    by = mission(spark, sf_dir).groupBy("grp").agg(F.count("*").alias("n"), F.sum("bits").cast("long").alias("bits"))
    return records.markdown(by, ["grp", "n", "bits"], ["grp"])


@query(f"""WITH d AS (SELECT coalesce(lang, 'und') AS grp, coalesce(source, '') AS source, CAST(n_chars AS DOUBLE) AS s, quality FROM documents JOIN labels USING (doc_id) WHERE n_chars IS NOT NULL), c AS (SELECT DISTINCT grp, source FROM d WHERE quality = 0),
 u AS (SELECT c.grp, c.source, s, 0 AS y FROM d, c WHERE quality = 1 UNION ALL SELECT grp, source, s, 1 FROM d WHERE quality = 0), m AS (SELECT grp, source, y, rank() OVER (PARTITION BY grp, source ORDER BY s) + (count(*) OVER (PARTITION BY grp, source, s) - 1) / 2.0 AS mid FROM u),
 a AS (SELECT grp, grp || '/' || source AS class, round({AUC}, 9) AS roc_auc, CAST(sum(y) AS BIGINT) AS n FROM m GROUP BY grp, source) SELECT *, row_number() OVER (PARTITION BY grp ORDER BY roc_auc DESC, class) AS place FROM a""")
def class_quality_order(spark, sf_dir):
    """Classes of each group by their AUC against the good rows, best first."""
    both = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").filter("n_chars is not null")
    rows = both.select(F.concat_ws("/", F.coalesce("lang", F.lit("und")), F.coalesce("source", F.lit(""))).alias("class"), F.col("n_chars").cast("double").alias("s"), "quality")
    aucs = ranking.auc_against(rows.filter("quality = 1").select("s"), rows.filter("quality = 0").select("class", "s"), "class").withColumn("roc_auc", F.round("roc_auc", 9))
    grouped = aucs.withColumn("grp", F.substring_index("class", "/", 1))
    return grouped.withColumn("place", F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("roc_auc"), "class")).cast("long")).select("grp", "class", "roc_auc", "n", "place")


@query(f"""WITH {MISSION}, lost AS (SELECT DISTINCT idx FROM mission WHERE score > 100), held AS (SELECT DISTINCT idx FROM mission WHERE score > 60 AND sol > 5)
 SELECT idx, 'lost' AS state FROM lost UNION ALL SELECT idx, 'held' FROM held WHERE idx NOT IN (SELECT idx FROM lost)""")
def tile_membership(spark, sf_dir):
    items = mission(spark, sf_dir)
    lost, held = items.filter("score > 100").select("idx").distinct(), items.filter("score > 60 and sol > 5").select("idx").distinct()
    return lost.withColumn("state", F.lit("lost")).unionByName(held.join(lost, "idx", "left_anti").withColumn("state", F.lit("held")))
