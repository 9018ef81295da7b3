"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir), with ``docs`` as the stage before left them, and returns the documents that
stay, with the columns of ``documents``; the last one returns the pieces of the packed sequences.
"""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terratally.llm import bpe, exact_dedup, jaccard_join, packing, pii, quality
from terratally.llm.common import unused, written


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the one with the largest doc_id."""
    return exact_dedup.keep_last(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies, the one with the smallest doc_id."""
    return jaccard_join.keep_first(docs)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced; n_chars follows a changed text."""
    before = unused("before", docs)
    after = pii.pseudonymise(docs.withColumn(before, F.col("text")))
    n = F.when(F.col("text").eqNullSafe(F.col(before)), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType))
    return after.withColumn("n_chars", n).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 ids."""
    return packing.pack(docs, bpe.merges_vocabulary(public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [
    ("quality", good_quality),
    ("exact_dedup", without_copies),
    ("near_dedup", without_near_copies),
    ("pii", pseudonyms),
    ("packing", packed),
]

#: SQL can express neither the classifier nor the tokens; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name, keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)
