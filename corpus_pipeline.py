"""The corpus pipeline: five stages, each written as Parquet and read again by the next.

quality classifier, MinHash near-dedup, benchmark decontamination, mixing sources to
target weights, sharding. All but the last return the columns of ``documents``.
"""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from rotapanel.llm import decontaminate, mixing, near_dup, quality, sharding
from rotapanel.session import shared_dir


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the ordinal classifier takes for junk."""
    return quality.select_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates."""
    return near_dup.remove_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draws documents by the mix's weights: a document drawn in two epochs is two rows."""
    return mixing.mix_sources(docs).select(*docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the slot and the shard of each row."""
    return sharding.place(docs, instead="text")


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", one_of_each),
    ("decontaminate", decontamination),
    ("mix_sources", mix),
    ("shard", shard),
]
# The fitted classifier has no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each result is stored in the shared folder."""
    folder = f"{shared_dir(spark)}/rotapanel/{spark.sparkContext.applicationId}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
