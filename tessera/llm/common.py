"""Pieces that several training-data operators share."""

from __future__ import annotations

import sys
import types

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import discard, new_path  # noqa: F401

#: White space in every contract: space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows and bytes in one Arrow batch; texts may be very long, so batches are small.
ARROW_ROWS, ARROW_BYTES = 512, 8 << 20


def arrow_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small: a batch of long texts must fit a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def written(df: DataFrame, name: str, compression: str = "zstd", **options: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends there, and lost executors lose nothing."""
    spark = df.sparkSession
    path = new_path(spark, name)
    kept = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")  # nothing reads this plan's shuffle files again
    try:
        df.write.options(compression=compression, **options).parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, kept)
    return spark.read.schema(df.schema).parquet(path)


def text_of(column: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def text_bytes(column: str = "text") -> Column:
    """The UTF-8 bytes of the text, null as empty: what the Python operators read."""
    return text_of(column).cast("binary")


def word_count(column: str = "text") -> Column:
    """Number of words, native: starts of runs of non-space characters."""
    return F.regexp_count(text_of(column), F.lit(WORD)).cast("long")


def worker_cache(name: str) -> dict:
    """A dict that lives as long as the Python worker, over all its tasks."""
    module = sys.modules.setdefault("_tessera_worker_cache", types.ModuleType("_tessera_worker_cache"))
    return module.__dict__.setdefault(name, {})


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file is; executors call it themselves."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def one_of_ties(rows: DataFrame, keeps: Column, *key: str) -> DataFrame:
    """rows with kept: where keeps holds, for one row of each key. Keys seldom repeat; only then are rows numbered and written."""
    marked = rows.withColumn("kept", keeps)
    if marked.where("kept").groupBy(*key).agg(F.count(F.lit(1)).alias("c")).where("c > 1").isEmpty():
        return marked
    marked = written(marked.withColumn("rid", F.monotonically_increasing_id()), "ties")
    first = marked.where("kept").groupBy(*key).agg(F.min("rid").alias("rid")).select("rid", F.lit(True).alias("is_first"))
    return marked.join(first, "rid", "left").withColumn("kept", F.coalesce("is_first", F.lit(False))).drop("rid", "is_first")
