"""Where intermediate tables and output files go: the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import IntegralType, LongType


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; only where that is unset (tests), a folder of this machine."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("relaycast.local.dir", None)
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="relaycast-")
        spark.conf.set("relaycast.local.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: cuts lineage, outlives executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)



def long_ids(docs: DataFrame) -> DataFrame:
    """``docs`` with ``doc_id`` as a long; any integer type will do, another type is an error."""
    kind = docs.schema["doc_id"].dataType
    if kind == LongType():
        return docs
    if not isinstance(kind, IntegralType):
        raise TypeError(f"doc_id must be an integer, not {kind.simpleString()}: number the documents first")
    return docs.withColumn("doc_id", docs["doc_id"].cast("long"))
