"""The corpus pipeline: language ID, near-dedup, PII, packing. Each stage reads what the one before it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnflow.llm import language, neardup, packing, pii
from tarnflow.llm.common import let_go, scratch
from tarnflow.llm.queries import tokenizer_path

#: Least score of a language for a document none of whose words is known.
SURE = 0.5
ORACLE_SQL = None


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; the model learns from those that aren't held out."""
    known = language.accepted(docs, language.fitted(docs.filter(~language.held_out(F.col("doc_id")))), SURE)
    let_go()  # the driver's Python has sent the model
    return known


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return neardup.deduplicated(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; n_chars follows the text, and stays where the text is null."""
    return pii.redacted(docs).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' ids in sequences."""
    return packing.packed(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [("language_id", identify), ("near_dedup", dedup), ("pii", redact), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
