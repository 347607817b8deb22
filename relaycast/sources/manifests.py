"""Scans and sinks: manifests (CSV, Parquet), window logs (JSON lines), raw arrays (.npy), model artifacts."""

from __future__ import annotations

import io
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import arrays_sha256, canonical
from ..operators.replay import RECORD

MANIFEST = ("index", "split", "class", "sol", "source_filename")


def read_manifest_csv(spark: SparkSession, path: str) -> DataFrame:
    """A manifest with a header; missing columns are an error, a sol that is no integer is null."""
    raw = spark.read.option("header", True).csv(path)
    lacking = [c for c in MANIFEST if c not in raw.columns]
    if lacking:
        raise ValueError(f"manifest lacks {lacking}")
    return raw.select(F.col("index").try_cast("bigint").alias("index"), "split", "class", F.nullif(F.trim("sol"), F.lit("")).try_cast("bigint").alias("sol"), "source_filename")


def write_manifest_csv(rows: DataFrame, path: str) -> None:
    """A null sol is an empty field; the writer's commit makes all files appear or none."""
    rows.select(*MANIFEST).write.option("header", True).option("emptyValue", "").option("nullValue", "").csv(path)


def write_manifest_parquet(rows: DataFrame, path: str) -> None:
    """Partitioned by split, so that reading one split lists only its files; rewritten splits replace only themselves."""
    rows.select(*MANIFEST).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("split").option("compression", "snappy").parquet(path)


def read_window_log(spark: SparkSession, path: str) -> DataFrame:
    """Window records from JSON lines, blank lines skipped; none at all is an error."""
    rows = spark.read.schema(RECORD).json(path).filter("window is not null")
    if not rows.take(1):
        raise ValueError(f"no window records in {path}")
    return rows


def write_window_log(rows: DataFrame, path: str) -> None:
    rows.write.json(path)


def read_arrays(spark: SparkSession, path: str, size: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(good, bad): name, class folder and pixels of every .npy file below ``path`` but those in ``all`` folders; files that can't be read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.npy").load(path)
    parts = F.split("path", "/")
    named = files.select(F.element_at(parts, -1).alias("name"), F.element_at(parts, -2).alias("class"), "content")

    def run(batches):
        for batch in batches:
            pixels, problems = [], []
            for content in batch.column("content"):
                try:
                    a = np.load(io.BytesIO(content.as_py()), allow_pickle=False).astype(np.float32).ravel()
                    ok = size is None or a.size == size
                    pixels.append(a.tolist() if ok else None)
                    problems.append(None if ok else f"{a.size} values")
                except Exception as e:  # a damaged file is reported, not fatal
                    pixels.append(None)
                    problems.append(str(e)[:200])
            yield pa.RecordBatch.from_arrays([batch.column("name"), batch.column("class"), pa.array(pixels, pa.list_(pa.float32())), pa.array(problems, pa.string())], names=["name", "class", "pixels", "problem"])

    read = named.mapInArrow(run, "name string, class string, pixels array<float>, problem string")
    return read.filter("problem is null").drop("problem"), read.filter("problem is not null").drop("pixels")


def catalog(manifest: DataFrame) -> DataFrame:
    """By split: rows, distinct files, rows without a sol."""
    return manifest.groupBy("split").agg(F.count("*").alias("count"), F.countDistinct("source_filename").alias("n_unique_files"), F.count_if(F.col("sol").isNull()).alias("n_unparsed_sol"))


#: The catalog's own format; another one is refused.
CATALOG_VERSION = 1


def write_catalog(splits: DataFrame, path: str) -> None:
    """A row a split (what ``catalog`` gives, and a fingerprint), as JSON lines of this format's version."""
    splits.withColumn("format_version", F.lit(CATALOG_VERSION)).write.mode("overwrite").json(path)


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema("format_version int, split string, count bigint, n_unique_files bigint, n_unparsed_sol bigint, fingerprint string").json(path)
    other = rows.filter(~F.col("format_version").eqNullSafe(F.lit(CATALOG_VERSION))).select("format_version").first()
    if other:
        raise ValueError(f"{path} has format {other[0]}, not {CATALOG_VERSION}")
    return rows.drop("format_version")


def fingerprints(files: DataFrame, split: str = "split") -> DataFrame:
    """split, fingerprint of its (class, name, length) rows in any order: sums of parts of their hashes, so no split is gathered."""
    h = F.sha2(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("class", "name", "length"))), 256)
    sums = [F.sum(F.conv(F.substring(h, k, 15), 16, 10).cast("decimal(20,0)")).alias(f"s{k}") for k in (1, 16, 31, 46)]
    return files.groupBy(split).agg(F.count("*").alias("n"), *sums).select(split, F.sha2(F.concat_ws("|", "n", "s1", "s16", "s31", "s46"), 256).alias("fingerprint"))


def stale_splits(files: DataFrame, known: DataFrame) -> DataFrame:
    """Splits whose files are other than when the catalog was written, or that it doesn't have; only these need work."""
    return fingerprints(files).join(known.select("split", "fingerprint"), ["split", "fingerprint"], "left_anti").select("split")


def load_split(manifest: DataFrame, arrays: DataFrame, split: str) -> DataFrame:
    """A split's manifest rows with their arrays by (split, index); a row without its partner on either side fails the read."""
    rows, found = manifest.filter(F.col("split") == split), arrays.filter(F.col("split") == split)
    both = rows.withColumn("_m", F.lit(1)).join(found.withColumn("_a", F.lit(1)), ["split", "index"], "full")
    whole = F.when(F.col("_m").isNotNull() & F.col("_a").isNotNull(), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("no partner for index "), F.col("index").cast("string"))))
    return both.filter(whole).drop("_m", "_a")


def class_folders(files: DataFrame) -> DataFrame:
    """name, sorted |-joined classes of all folders but ``all``; 'unknown' where a canonical file has none."""
    canon = files.filter("class = 'all'").select("name").distinct()
    by = files.filter("class <> 'all'").groupBy("name").agg(F.array_join(F.array_sort(F.collect_set("class")), "|").alias("class"))
    return canon.join(by, "name", "left").select("name", F.coalesce("class", F.lit("unknown")).alias("class"))


def model_table(spark: SparkSession, arrays: dict[str, np.ndarray]) -> DataFrame:
    """A model as rows (name, dtype, shape, values)."""
    rows = [(k, str(a.dtype), list(a.shape), a.astype(float).ravel().tolist()) for k, a in arrays.items()]
    return spark.createDataFrame(rows, "name string, dtype string, shape array<int>, values array<double>")


def read_model(rows: DataFrame) -> dict[str, np.ndarray]:
    return {r.name: np.array(r["values"]).reshape(r.shape).astype(r.dtype) for r in rows.collect()}


#: The artifact's own format; another one is refused.
ARTIFACT_VERSION = 1


def write_artifact(spark: SparkSession, path: str, kind: str, arrays: dict[str, np.ndarray], settings: dict) -> str:
    """A model's arrays with a card: format, kind, settings and the content's hash, which is returned."""
    content = arrays_sha256({k: np.asarray(a, float) for k, a in arrays.items()})
    model_table(spark, arrays).coalesce(1).write.mode("overwrite").parquet(f"{path}/arrays")
    card = [(ARTIFACT_VERSION, kind, canonical(settings), content)]
    spark.createDataFrame(card, "format_version int, kind string, settings string, content_sha256 string").coalesce(1).write.mode("overwrite").json(f"{path}/card")
    return content


def read_artifact(spark: SparkSession, path: str, kind: str | None = None) -> tuple[dict[str, np.ndarray], dict]:
    """(arrays, settings) of an artifact; another format or kind, or arrays that aren't those of the card, are errors."""
    card = spark.read.schema("format_version int, kind string, settings string, content_sha256 string").json(f"{path}/card").first()
    if card is None or card.format_version != ARTIFACT_VERSION:
        raise ValueError(f"{path} has format {card and card.format_version}, not {ARTIFACT_VERSION}")
    if kind is not None and card.kind != kind:
        raise ValueError(f"{path} is a {card.kind}, not a {kind}")
    arrays = read_model(spark.read.parquet(f"{path}/arrays"))
    if arrays_sha256({k: np.asarray(a, float) for k, a in arrays.items()}) != card.content_sha256:
        raise ValueError(f"the arrays of {path} aren't those that its card names")
    return arrays, json.loads(card.settings)
