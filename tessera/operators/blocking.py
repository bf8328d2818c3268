"""Blocks: only records of one country and state are compared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MIN_TOKEN, MIN_SEEN, MIN_SHARE = 3, 20, 0.95


def first_state(state: Column) -> Column:
    """The first code of a state list; the two states that were one until 2014 share a block."""
    first = F.element_at(F.split(F.coalesce(state, F.lit("")), " "), 1)
    return F.when(first == "tg", "ap").otherwise(first)


def s1_blocks(s1: DataFrame) -> DataFrame:
    return s1.withColumn("block", first_state(F.col("state")))


def state_purity(s1: DataFrame, min_seen: int = MIN_SEEN, min_share: float = MIN_SHARE) -> DataFrame:
    """country, token, block, p: address tokens of S1 that nearly always stand with one state."""
    seen = s1.where("block <> ''").select("country", "block", F.explode(F.split("addr", " ")).alias("token")).where(F.length("token") >= MIN_TOKEN)
    counted = seen.groupBy("country", "token", "block").agg(F.count(F.lit(1)).alias("n"))
    total = counted.withColumn("total", F.sum("n").over(Window.partitionBy("country", "token")))
    # A share this large can only be the largest.
    return total.where((F.col("total") >= min_seen) & (F.col("n") / F.col("total") >= min_share)).select("country", "token", "block", (F.col("n") / F.col("total")).alias("p"))


def target_blocks(targets: DataFrame, purity: DataFrame) -> DataFrame:
    """targets with block; where no state was found, the one that the address's pure tokens vote for, if any."""
    known = targets.withColumn("block", first_state(F.col("state")))
    lost = known.where("block = ''").select("entity_id", "country", F.explode(F.split("addr", " ")).alias("token"))
    votes = lost.join(purity, ["country", "token"]).groupBy("entity_id", "block").agg(F.round(F.sum("p"), 6).alias("votes"))
    best = Window.partitionBy("entity_id").orderBy(F.desc("votes"), "block")
    won = votes.withColumn("r", F.row_number().over(best)).where("r = 1").select("entity_id", F.col("block").alias("voted"))
    return known.join(won, "entity_id", "left").withColumn("block", F.coalesce("voted", "block")).drop("voted")
