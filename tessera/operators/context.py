"""What a pair looks like among its rivals: window features over the whole pair table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NAME_PART, ADDR_PART = 0.6, 0.4


def context_features(pairs: DataFrame) -> DataFrame:
    """pairs with ret_score, counts, ranks and gaps to the best, around the S1 record and around the target."""
    score = NAME_PART * F.coalesce("name_cos", F.lit(0.0)) + ADDR_PART * F.coalesce("addr_cos", F.lit(0.0))
    pairs = pairs.withColumn("ret_score", score)
    by_s1, by_t = Window.partitionBy("s1"), Window.partitionBy("t")
    best = F.round("ret_score", 6).desc()
    s1_side = pairs.withColumns({
        "s1_n_cands": F.count(F.lit(1)).over(by_s1), "s1_gap": F.max("ret_score").over(by_s1) - F.col("ret_score"),
        "s1_rank": F.row_number().over(by_s1.orderBy(best, "t")) - 1,
    })
    return s1_side.withColumns({
        "t_n_cands": F.count(F.lit(1)).over(by_t), "t_gap": F.max("ret_score").over(by_t) - F.col("ret_score"),
        "t_rank": F.row_number().over(by_t.orderBy(best, "s1")) - 1,
        "t_name_gap": F.max("name_cos").over(by_t) - F.col("name_cos"), "t_addr_gap": F.max("addr_cos").over(by_t) - F.col("addr_cos"),
    })
