"""TF-IDF vectors as a long table of weights, one corpus per block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Features in more than this share of a block's records, and more than so many of them, are left out.
MAX_SHARE, CAP_FLOOR = 0.01, 50


def trigrams(c: Column) -> Column:
    """Runs of three characters; shorter strings have none."""
    return F.when(F.length(c) >= 3, F.transform(F.sequence(F.lit(1), F.length(c) - 2), lambda i: F.substring(c, i, F.lit(3)))).otherwise(F.array().cast("array<string>"))


def address_features(addr: Column, numbers: Column) -> Column:
    """Words of an address, and its numbers marked as such."""
    return F.filter(F.split(F.concat_ws(" ", addr, F.regexp_replace(numbers, r"(\d+)", "#$1")), " "), lambda t: t != "")


def counts(records: DataFrame, features: Column, corpus: list[str]) -> DataFrame:
    """corpus columns, entity_id, f, tf."""
    return records.select(*corpus, "entity_id", F.explode(features).alias("f")).groupBy(*corpus, "entity_id", "f").agg(F.count(F.lit(1)).alias("tf"))


def tfidf(records: DataFrame, features: Column, corpus: list[str], max_share: float = MAX_SHARE, cap_floor: int = CAP_FLOOR) -> DataFrame:
    """corpus columns, entity_id, f, w: damped counts by smooth idf, without rare and too frequent features, then of length one.

    The cap on frequent features is what keeps the join of two such tables near linear. A row with a column
    `times` stands for so many records that are alike.
    """
    records = records if "times" in records.columns else records.withColumn("times", F.lit(1))
    tf = counts(records, features, [*corpus, "times"])
    n = records.groupBy(*corpus).agg(F.sum("times").alias("n"))
    df = tf.groupBy(*corpus, "f").agg(F.sum("times").alias("df")).join(n, corpus)
    cap = F.greatest(F.floor(F.lit(max_share) * F.col("n")), F.lit(cap_floor))
    idf = df.where((F.col("df") >= 2) & (F.col("df") <= cap)).select(*corpus, "f", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    raw = tf.join(idf, [*corpus, "f"]).select(*corpus, "entity_id", "f", ((1 + F.log("tf")) * F.col("idf")).alias("v"))
    # A record's features are few: a window over them needs one shuffle where a join back would compute them twice.
    norm = F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy(*corpus, "entity_id")))
    return raw.select(*corpus, "entity_id", "f", (F.col("v") / norm).alias("w"))
