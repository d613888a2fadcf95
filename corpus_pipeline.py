"""The corpus pipeline: stages over ``documents``, each one operator, each written and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from seacast.llm import cutting, exthash, mixing, ordermin, quality
from seacast.session import stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality.quality_cascade(docs).where("kept").select(docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each normalised text."""
    kept = exthash.exact_dedup(docs).where("kept")
    return exthash.one_row_per_key(kept).where("kept").select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return ordermin.kept_documents(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: documents repeated by epoch, the one at each budget cut to its first words."""
    return mixing.mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the packed sequences."""
    return cutting.pack(docs, public_tokenizers.path("word_bpe_49k.json"), spaces=False, end_id=1)


STAGES = [
    ("quality rules", quality_rules), ("exact dedup", exact_dedup), ("minhash near dedup", near_dedup),
    ("mixing", mix), ("packing", packing),
]

#: Near-duplicate classes and packing are not expressible in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
