"""Nested run records, result tables in several formats, the grid of cells, checksums, lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.numbering import numbered

RUN = (
    "tier string, seed bigint, metrics struct<roc_auc: double, precision_at_k: map<string,double>, recall_at_k: map<string,double>>, "
    "decomposed map<string,struct<n: bigint, roc_auc: double>>, per_class_roc_auc map<string,struct<n: bigint, roc_auc: double>>, cost struct<param_count: bigint, flops_per_inference: bigint, cycles_per_inference: double, wall_clock_seconds: double>"
)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """One row a JSON file; a missing tier is the file's stem up to its last '-s'."""
    raw = spark.read.schema(RUN).option("multiLine", True).json(path).withColumn("file", F.input_file_name())
    stem = F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\.json$", "")
    return raw.withColumn("tier", F.coalesce("tier", F.regexp_replace(stem, "-s[^-]*$", ""))).drop("file")


def mean_sd_by_tier(runs: DataFrame) -> DataFrame:
    """tier, k, mean and population deviation of precision over seeds, in numeric order of k."""
    each = runs.select("tier", F.explode("metrics.precision_at_k").alias("k", "p")).withColumn("k", F.col("k").cast("bigint"))
    return each.groupBy("tier", "k").agg(F.avg("p").alias("mean"), F.stddev_pop("p").alias("sd"), F.count("p").alias("n"))


def write_results(df: DataFrame, path: str, order: list[Column | str] | None = None) -> None:
    """The same rows as CSV, JSON and Parquet below ``path``; few rows, with an ``order``, as a Markdown table too."""
    df.write.mode("overwrite").option("header", True).csv(f"{path}/csv")
    df.write.mode("overwrite").json(f"{path}/json")
    df.write.mode("overwrite").parquet(f"{path}/parquet")
    if order:
        markdown(df, df.columns, order).orderBy("line_no").select("line").write.mode("overwrite").text(f"{path}/markdown")


def write_grid(cells: DataFrame, path: str, axes: tuple[str, ...] = ("hardware", "tier", "adaptation", "policy")) -> None:
    """Partitioned by its axes, so that one cell reads one folder; rewritten cells replace only themselves."""
    cells.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*axes).parquet(path)


def lookup(df: DataFrame, **keys) -> DataFrame:
    """Rows with these values; on a partitioned table only their folders are read."""
    for k, v in keys.items():
        df = df.filter(F.col(k).eqNullSafe(F.lit(v)))
    return df


def with_notes(log: DataFrame, notes: DataFrame, name: str = "operator_note") -> DataFrame:
    """A window log with a text column joined in by window; an older one is replaced."""
    return log.drop(name).join(notes.select("window", F.col("note").alias(name)), "window", "left")


def markdown(df: DataFrame, columns: list[str], order: list[Column | str]) -> DataFrame:
    """line_no, line: a table as Markdown; rows of any number are numbered in ``order`` by ranges."""
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("–")) for c in columns]), F.lit(" |"))
    body = numbered(df.withColumn("line", cells), *order, name="line_no", start=2).select(F.col("line_no").cast("int").alias("line_no"), "line")
    head = [(0, "| " + " | ".join(columns) + " |"), (1, "|" + "---|" * len(columns))]
    return df.sparkSession.createDataFrame(head, "line_no int, line string").unionByName(body)


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """path, length, md5 of files."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.md5("content").alias("md5"))
