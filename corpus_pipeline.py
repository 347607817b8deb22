"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again by the next.

1. quality classifier: documents that the factorisation machine rejects go;
2. line dedup: later copies of runs of lines are cut out; a document left without a word goes;
3. near dedup: one document of each group of near copies (five-word shingles, similarity 0.8) stays;
4. benchmark decontamination: contaminated documents go;
5. BPE encoding and decoding: token ids of what is left, and the text that they decode to.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relaycast.llm import bpe, decontaminate, factorisation_machine, line_dedup, near_dedup
from relaycast.llm._store import stored
from relaycast.llm.queries import tokenizer_path
from relaycast.session import table, with_workers


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    with_workers(spark)
    machine = factorisation_machine.train(docs, table(spark, sf_dir, "labels"))
    return factorisation_machine.classify(docs, machine, row=True).filter("predicted = 1").select("row.*")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = line_dedup.line_dedup(docs, row=True)
    left = found.filter((F.col("n_removed") == 0) | F.col("kept_text").rlike(r"[^\x20\x09-\x0D]"))
    edited = {"text": F.col("kept_text"), "n_chars": F.when(F.col("n_removed") == 0, F.col("row.n_chars")).otherwise(F.char_length("kept_text"))}
    return left.select(*[edited.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    with_workers(spark)
    kept = near_dedup.near_dedup(docs).filter("kept").select(F.col("doc_id").alias("kept_id"))
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("kept_id")), "left_semi").dropDuplicates(["doc_id", "text"])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    with_workers(spark)
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), row=True).filter("not contaminated").select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    with_workers(spark)
    return bpe.encode_decode(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", classify_quality),
    ("line_dedup", dedup_lines),
    ("minhash_near_dedup", dedup_near),
    ("benchmark_decontamination", drop_contaminated),
    ("bpe_encode_decode", encode),
]

#: The trained classifier is beyond SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
