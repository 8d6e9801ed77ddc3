"""From raw documents to packed token windows: each stage calls one operator and is written
as Parquet before the next one reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import mixing, packing, pii, quality, simhash
from spanloom.llm.common import written

SHINGLE = 5


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality.kept_documents(docs)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one with the smallest id."""
    return simhash.one_of_each(docs, shingle=SHINGLE)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with pseudonyms in place of personal data; ``n_chars`` follows the text."""
    rows = pii.pseudonymise(docs)
    n_chars = F.length("text").cast(docs.schema["n_chars"].dataType)
    return rows.withColumn("n_chars", F.when(F.size("pii") > 0, n_chars).otherwise(F.col("n_chars"))).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often, and as far, as its source's target takes it."""
    return mixing.mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of 2048 tokens, every window with all sources."""
    pieces = packing.pack(docs.select("doc_id", "source", "text"))
    return pieces.select(
        "sequence_id", "offset", "doc_id", "source", "start", "length", "doc_tokens", F.crc32("ids").alias("ids_crc32")
    )


STAGES = [
    ("quality", quality_stage),
    ("dedup", dedup_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Hashes, permutations and a tokenizer are beyond SQL; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
