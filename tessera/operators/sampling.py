"""Buckets, folds and samples that a record's id alone decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def id_bucket(entity_id: Column, n: int) -> Column:
    """The number in an id ("S1-00000012": 12) modulo n."""
    return F.pmod(F.substring(entity_id, 4, 32).cast("bigint"), F.lit(n)).cast("int")


def with_folds(s1: DataFrame, n: int = 5) -> DataFrame:
    return s1.withColumn("fold", id_bucket(F.col("entity_id"), n))


def sample_world(s1: DataFrame, targets: DataFrame, truth: DataFrame | None, fraction: float) -> tuple[DataFrame, DataFrame]:
    """A smaller world of the same shape: a share of S1, all copies of those, and the same share of all other targets."""
    keep = id_bucket(F.col("entity_id"), 10_000) < int(fraction * 10_000)
    some = s1.where(keep)
    if truth is None:
        return some, targets.where(keep)
    linked = targets.join(truth.join(some.selectExpr("entity_id AS s1"), "s1", "left_semi").selectExpr("t AS entity_id"), "entity_id", "left_semi")
    others = targets.join(truth.selectExpr("t AS entity_id"), "entity_id", "left_anti").where(keep)
    return some, linked.unionByName(others)


def seeded_sample(df: DataFrame, n: int, key: str, seed: int) -> DataFrame:
    """n rows without replacement, the same on every run and engine: the least by a digest of key and seed."""
    return df.orderBy(F.md5(F.concat(F.col(key), F.lit(f":{seed}"))), F.col(key)).limit(n)


def entity_subsets(s1: DataFrame, most: int, seed: int = 7) -> DataFrame:
    """entity_id and role of S1 records: fold 0 validates, fold 4 tunes, the others train; each role at most so many."""
    folded = with_folds(s1).select("entity_id", F.when(F.col("fold") == 0, "val").when(F.col("fold") == 4, "tune").otherwise("train").alias("role"))
    parts = [seeded_sample(folded.where(F.col("role") == r), most, "entity_id", seed) for r in ("val", "tune", "train")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
