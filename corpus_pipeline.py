"""A training corpus from raw documents, in five stages.

Each stage reads all that the one before kept, written as Parquet in between. All but the last
return the columns of documents; the last returns the packed pieces with their token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import exact_dedup, mixing, packing, quality_rules, simhash
from tessera.sources.scratch import delete, intermediates, new_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_first(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, with_ids=True)


STAGES = [("quality rules", quality), ("exact dedup", exact), ("near dedup", near), ("mix sources", mix), ("pack", pack)]
#: SQL can't express the votes' expectation-maximisation, nor the rounds of near dedup and packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written in the shared folder and read again."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name.replace(' ', '-')}")
        with intermediates(spark):  # what a stage writes for itself goes when its result is written
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            delete(spark, before)
        before = path
    return docs
