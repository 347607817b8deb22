"""Array files: tables written to them and read back, whole or by ranges of rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators.numbering import numbered_within
from ..session import shared_path, table
from ..sources import tensors
from .registry import query

_SUMS = "CAST(len(embedding) AS BIGINT) AS n_values, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6) AS total, round(CAST(embedding[1] AS DOUBLE), 6) AS first_value"
ROWS = f"rows_ AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS idx, {_SUMS} FROM embeddings)"


def _sums(read):
    total = V.total(V.doubles(F.col("values")))
    return read.select(F.col("index").alias("idx"), F.size("values").cast("long").alias("n_values"), F.round(total, 6).alias("total"), F.round(F.get("values", F.lit(0)).cast("double"), 6).alias("first_value"))


def _values(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("values"))


@query(f"WITH {ROWS} SELECT * FROM rows_")
def tensor_roundtrip(spark, sf_dir):
    """Rows written by many tasks as committed files and read back in order."""
    return _sums(tensors.through_files(_values(spark, sf_dir), (4, 4, 4), "vec_id"))


@query(f"WITH {ROWS} SELECT * FROM rows_ WHERE idx >= 100")
def array_range(spark, sf_dir):
    """One file in place, of which a range of rows is read."""
    path = shared_path(spark, "array") + ".npy"
    tensors.write_array(_values(spark, sf_dir), path, (4, 4, 4), "vec_id")
    return _sums(tensors.read_tensors(spark, path, **{"from": 100}))


@query("""SELECT label AS class, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS idx, vec_id FROM embeddings""")
def class_index(spark, sf_dir):
    """A row's place in its class, however large the class is."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").alias("class"), "vec_id")
    return numbered_within(rows, ["class"], "vec_id", name="idx")
