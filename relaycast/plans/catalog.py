"""Manifests, labels, integrity checks, set operations, joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import labels as L
from ..operators import digests
from ..operators import integrity as I
from ..operators.numbering import numbered
from ..session import table
from ..sources import manifests
from .registry import MISSION, digest_tree_sql, longs, mission, query


@query("SELECT event_type AS class, count(*) AS n FROM events GROUP BY 1")
def manifest_class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("class")).agg(F.count("*").alias("n")), "n")


@query(f"WITH {MISSION} SELECT count(*) FILTER (WHERE grp = 'natural') AS n_natural, count(*) FILTER (WHERE grp = 'rover') AS n_rover, count(*) FILTER (WHERE grp = 'typical') AS n_typical, count(*) FILTER (WHERE grp = 'excluded') AS n_excluded FROM mission")
def composition_conditional(spark, sf_dir):
    return mission(spark, sf_dir).agg(*(F.count_if(F.col("grp") == g).alias(f"n_{g}") for g in ("natural", "rover", "typical", "excluded")))


@query(f"WITH {MISSION} SELECT grp, count(*) AS n, sum(bits) AS bits FROM mission GROUP BY grp")
def mission_composition(spark, sf_dir):
    return mission(spark, sf_dir).groupBy("grp").agg(F.count("*").alias("n"), F.sum("bits").alias("bits"))


@query(f"""WITH lines AS (SELECT event_type AS key, lpad(CAST(event_id AS VARCHAR), 20, '0') AS line FROM events), {digest_tree_sql("lines")}, ids AS (SELECT event_type AS class, min(event_id) AS first_index, max(event_id) AS last_index FROM events GROUP BY 1)
  SELECT class, n_lines AS n, first_index, last_index, digest AS order_sha256 FROM ids JOIN tree_root ON tree_root.key = class""")
def group_by_split(spark, sf_dir):
    """A class's rows in order, as a digest tree: no class is gathered."""
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("class"), "event_id")
    made = digests.roots(digests.tree(rows, "class", F.lpad(F.col("event_id").cast("string"), 20, "0")))
    ends = rows.groupBy("class").agg(F.min("event_id").alias("first_index"), F.max("event_id").alias("last_index"))
    return ends.join(made.withColumnRenamed("key", "class"), "class").select("class", F.col("n_lines").alias("n"), "first_index", "last_index", F.col("digest").alias("order_sha256"))


@query("""SELECT lang AS split, count(*) AS n, count(DISTINCT text) AS n_unique, count(*) FILTER (WHERE l.quality IS NULL) AS n_unlabelled
  FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1""")
def split_stats_distinct_nulls(spark, sf_dir):
    both = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return both.groupBy(F.col("lang").alias("split")).agg(F.count("*").alias("n"), F.countDistinct("text").alias("n_unique"), F.count_if(F.col("quality").isNull()).alias("n_unlabelled"))


@query("SELECT sha256(text) AS name, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    return I.duplicates(table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("name")), ["name"])


@query("SELECT sha256(text) AS name, count(DISTINCT source) AS n_groups FROM documents GROUP BY text HAVING count(DISTINCT source) > 1")
def cross_group_collisions(spark, sf_dir):
    return I.collisions(table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("name"), "source"), "name", "source")


NAMES = """names AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'no_day_' || doc_id || '.npy'
   ELSE 'mcam' || lpad(CAST(doc_id AS VARCHAR), 5, '0') || '_' || upper(substr(lang, 1, 1)) || '_0_sol' || lpad(CAST(doc_id % 30 AS VARCHAR), 4, '0') || '_' || doc_id || '.npy' END AS name FROM documents)"""


def names(spark, sf_dir):
    i = F.col("doc_id").cast("string")
    made = F.concat(F.lit("mcam"), F.lpad(i, 5, "0"), F.lit("_"), F.upper(F.substring("lang", 1, 1)), F.lit("_0_sol"), F.lpad((F.col("doc_id") % 30).cast("string"), 4, "0"), F.lit("_"), i, F.lit(".npy"))
    return table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("no_day_"), i, F.lit(".npy"))).otherwise(made).alias("name"))


@query(f"""WITH {NAMES} SELECT doc_id, name AS source_filename,
  TRY_CAST(nullif(regexp_extract(name, '(?i)sol[_\\-]?(\\d{{1,6}})', 1), '') AS BIGINT) AS sol,
  nullif(upper(regexp_extract(name, '(?i)mcam\\d+[_\\-]([A-Za-z]{{1,3}})', 1)), '') AS camera,
  TRY_CAST(nullif(regexp_extract(name, '(?i)mcam(\\d+)', 1), '') AS BIGINT) AS sequence FROM names""")
def filename_parse(spark, sf_dir):
    return names(spark, sf_dir).select("doc_id", L.frame_meta(F.col("name")).alias("m")).select("doc_id", "m.*")


@query(f"""WITH {NAMES}, p AS (SELECT doc_id, name, TRY_CAST(nullif(regexp_extract(name, '(?i)sol[_\\-]?(\\d{{1,6}})', 1), '') AS BIGINT) AS sol, TRY_CAST(nullif(regexp_extract(name, '(?i)mcam(\\d+)', 1), '') AS BIGINT) AS seq FROM names)
  SELECT doc_id, row_number() OVER (ORDER BY coalesce(sol, 1000000000), coalesce(seq, 1000000000), name) AS place FROM p""")
def filename_order(spark, sf_dir):
    far = F.lit(1_000_000_000)
    own = names(spark, sf_dir).select("doc_id", "name", F.coalesce(L.parse_sol(F.col("name")), far).alias("sol"), F.coalesce(L.parse_sequence(F.col("name")), far).alias("seq"))
    return numbered(own, "sol", "seq", "name", start=1).select("doc_id", "place")


FIELDS = """fields AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 5 = 1 THEN 'veins|drt' WHEN doc_id % 5 = 2 THEN 'scuff||' || lang WHEN doc_id % 5 = 3 THEN 'meteorite' ELSE lang || '|other' END AS field FROM documents)"""


def fields(spark, sf_dir):
    k, lang = F.col("doc_id") % 5, F.col("lang")
    return table(spark, sf_dir, "documents").select("doc_id", F.when(k == 1, "veins|drt").when(k == 2, F.concat(F.lit("scuff||"), lang)).when(k == 3, "meteorite").when(k == 4, F.concat(lang, F.lit("|other"))).alias("field"))


@query(f"""WITH {FIELDS}, s AS (SELECT doc_id, list_filter(string_split(coalesce(field, ''), '|'), lambda x: x <> '') AS labels FROM fields),
 g AS (SELECT doc_id, labels, list_sort(list_distinct(list_transform(labels, lambda x: CASE WHEN x IN ('veins','broken-rock','float','bedrock','meteorite') THEN 'natural' WHEN x IN ('drt','dump-pile','drill-hole','scuff') THEN 'rover' ELSE 'excluded' END))) AS groups FROM s)
 SELECT doc_id, CAST(len(labels) AS BIGINT) AS n_labels, CASE WHEN len(groups) = 0 THEN 'excluded' ELSE array_to_string(groups, '|') END AS groups,
  CASE WHEN list_contains(groups, 'natural') THEN 'natural' WHEN list_contains(groups, 'rover') THEN 'rover' ELSE 'excluded' END AS mission_group,
  CASE WHEN len(labels) = 0 THEN 'unknown' ELSE array_to_string(list_sort(list_distinct(labels)), '|') END AS class FROM g""")
def multilabel_groups(spark, sf_dir):
    seen = fields(spark, sf_dir).select("doc_id", L.split_labels(F.col("field")).alias("labels")).withColumn("groups", L.groups_for_labels(F.col("labels")))
    return seen.select("doc_id", F.size("labels").cast("long").alias("n_labels"), F.array_join("groups", "|").alias("groups"), L.mission_group(F.lit("test_novel_all"), F.col("groups")).alias("mission_group"), L.join_labels(F.col("labels")).alias("class"))


@query(f"""WITH {FIELDS}, x AS (SELECT doc_id, unnest(list_filter(string_split(coalesce(field, ''), '|'), lambda x: x <> '')) AS label FROM fields),
 dim(label, grp) AS (VALUES ('veins','natural'),('broken-rock','natural'),('float','natural'),('bedrock','natural'),('meteorite','natural'),('drt','rover'),('dump-pile','rover'),('drill-hole','rover'),('scuff','rover'),('other','excluded'),('edge_cases','excluded'))
 SELECT coalesce(grp, 'excluded') AS grp, count(*) AS n, count(DISTINCT doc_id) AS n_frames FROM x LEFT JOIN dim USING (label) GROUP BY 1""")
def taxonomy_join(spark, sf_dir):
    dim = spark.createDataFrame([(x, g) for g, xs in (("natural", L.NATURAL), ("rover", L.ROVER), ("excluded", L.EXCLUDED)) for x in xs], "label string, grp string")
    each = fields(spark, sf_dir).select("doc_id", F.explode(L.split_labels(F.col("field"))).alias("label"))
    joined = each.join(F.broadcast(dim), "label", "left")  # a fixed dimension of eleven rows
    return joined.groupBy(F.coalesce("grp", F.lit("excluded")).alias("grp")).agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_frames"))


@query("""SELECT d.doc_id, coalesce(array_to_string(list_sort(list_distinct(list(CAST(l.quality AS VARCHAR)) FILTER (WHERE l.quality IS NOT NULL))), '|'), 'unknown') AS class
  FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1""")
def label_join_left(spark, sf_dir):
    by = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.collect_set(F.col("quality").cast("string")).alias("labels"))
    return table(spark, sf_dir, "documents").select("doc_id").join(by, "doc_id", "left").select("doc_id", L.join_labels(F.coalesce("labels", F.array().cast("array<string>"))).alias("class"))


@query("""WITH a AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS k FROM documents), n AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang),
 o AS (SELECT lang, coalesce(sum(n) OVER (ORDER BY lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM n) SELECT doc_id, CAST(k + base AS BIGINT) AS idx FROM a JOIN o USING (lang)""")
def split_union_all(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return I.concatenate(docs, "lang", "doc_id").select("doc_id", "idx")


@query("SELECT doc_id FROM documents WHERE lang IS NOT NULL INTERSECT SELECT doc_id FROM labels")
def split_intersect(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter("lang is not null").select("doc_id").intersect(table(spark, sf_dir, "labels").select("doc_id"))


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def split_except(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").exceptAll(table(spark, sf_dir, "labels").select("doc_id")).distinct()


@query("SELECT min(doc_id) AS doc_id, sha256(text) AS name FROM documents GROUP BY text")
def dedup_first(spark, sf_dir):
    return I.keep_first(table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("name")), ["name"], "doc_id").select("doc_id", "name")


@query("""WITH s AS (SELECT DISTINCT source, text FROM documents) SELECT a.source AS left_split, b.source AS right_split, count(*) AS n_shared FROM s a JOIN s b ON a.text = b.text AND a.source < b.source GROUP BY 1, 2""")
def cross_split_overlap(spark, sf_dir):
    return I.overlaps(table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("name"), "source"), "name", "source")


@query("""WITH p AS (SELECT url, string_split(regexp_replace(url, '^[a-z]+://', ''), '/') AS parts FROM pages) SELECT url, list_contains(parts[1:len(parts)-1], 'all') AS leaks FROM p""")
def path_leak_check(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("url", I.leaks(F.regexp_replace("url", "^[a-z]+://", ""), "all").alias("leaks"))


@query("""SELECT d.doc_id, array_to_string(list_concat(CASE WHEN l.quality IS NULL THEN ['quality'] ELSE [] END, CASE WHEN l.toxic IS NULL THEN ['toxic'] ELSE [] END), ',') AS missing
  FROM documents d LEFT JOIN labels l USING (doc_id)""")
def missing_field_audit(spark, sf_dir):
    both = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return both.select("doc_id", F.array_join(I.missing("quality", "toxic"), ",").alias("missing"))


@query(f"""WITH lines AS (SELECT lang AS key, source || '|' || doc_id || '|' || n_chars AS line FROM documents), {digest_tree_sql("lines")} SELECT key AS class, digest AS fingerprint, n_lines FROM tree_root""")
def fingerprint_sha(spark, sf_dir):
    line = F.concat_ws("|", "source", F.col("doc_id").cast("string"), F.col("n_chars").cast("string"))
    made = digests.tree(table(spark, sf_dir, "documents"), "lang", line)
    return digests.roots(made).select(F.col("key").alias("class"), F.col("digest").alias("fingerprint"), "n_lines")


@query(f"""WITH lines AS (SELECT lang AS key, lpad(CAST(doc_id AS VARCHAR), 20, '0') || ' ' || sha256(text) AS line FROM documents),
  edited AS (SELECT lang AS key, lpad(CAST(doc_id AS VARCHAR), 20, '0') || ' ' || sha256(CASE WHEN quality = 0 AND toxic = 1 THEN text || '.' ELSE text END) AS line FROM documents LEFT JOIN labels USING (doc_id)),
  {digest_tree_sql("lines", "a")}, {digest_tree_sql("edited", "b")}
  SELECT key AS class, node FROM a_0 FULL JOIN b_0 USING (key, node) WHERE a_0.digest IS DISTINCT FROM b_0.digest""")
def changed_runs(spark, sf_dir):
    """Runs of rows that an edit of some texts changed, found by descending both trees."""
    both = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    name = F.lpad(F.col("doc_id").cast("string"), 20, "0")
    text = F.when((F.col("quality") == 0) & (F.col("toxic") == 1), F.concat("text", F.lit("."))).otherwise(F.col("text"))
    old, new = (digests.tree(both, "lang", F.concat_ws(" ", name, F.sha2(t, 256))) for t in (F.col("text"), text))
    return digests.changed(old, new).select(F.col("key").alias("class"), "node")


@query("""SELECT DISTINCT lang || '/' || source AS split FROM documents JOIN labels USING (doc_id) WHERE quality = 0 AND toxic = 1""")
def stale_split_scan(spark, sf_dir):
    """Splits whose files changed since the catalog was written, by fingerprints that no order and no layout changes."""
    both = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    files = both.select(F.concat_ws("/", "lang", "source").alias("split"), "lang", F.col("doc_id").alias("name"), "n_chars", "quality", "toxic")
    before = files.select("split", F.col("lang").alias("class"), "name", F.col("n_chars").alias("length"))
    longer = F.when((F.col("quality") == 0) & (F.col("toxic") == 1), F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    after = files.select("split", F.col("lang").alias("class"), "name", longer.alias("length"))
    return manifests.stale_splits(after, manifests.fingerprints(before))


@query("SELECT idx, place FROM (SELECT event_id AS idx, event_type, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS place FROM events) WHERE place <= 25")
def limit_per_split(spark, sf_dir):
    w = W.partitionBy("event_type").orderBy(F.desc("value"), "event_id")
    return table(spark, sf_dir, "events").withColumn("place", F.row_number().over(w).cast("long")).filter("place <= 25").select(F.col("event_id").alias("idx"), "place")


@query("""WITH c(split, pos) AS (VALUES ('en', 0), ('fr', 1)) SELECT doc_id, CAST(row_number() OVER (ORDER BY coalesce(pos, 99), lang, doc_id) AS BIGINT) AS place FROM documents LEFT JOIN c ON lang = split""")
def custom_split_order(spark, sf_dir):
    pos = F.when(F.col("lang") == "en", 0).when(F.col("lang") == "fr", 1).otherwise(99)
    return numbered(table(spark, sf_dir, "documents").select("doc_id", "lang", pos.alias("pos")), "pos", "lang", "doc_id", start=1).select("doc_id", "place")
