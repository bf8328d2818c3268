"""Operator 9, exact dedup: distributed most-significant-digit radix partitioning.

Documents start in one group, and each round splits every group by the next digit of its texts'
UTF-8 bytes: a row is dealt by the number of its group and that digit alone. A digit is a run of
bytes, 256 at first and three times as many as all before in each round, so a text of n bytes needs
about log4(n / 256) rounds. A group that a round leaves with one row, or whose texts have ended, is
finished. Only rows of unfinished groups are read by the next round. No digest decides equality.

Each round is one hash aggregation (with partial sums on the map side, so a group of copies that
holds a third of all rows costs a row per task) and one left join back, which adaptive execution
splits where a group is large.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, one_of_ties, table, text_of, written

FIRST_DIGIT, GROWTH = 256, 4


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", carry: list[str] | None = None) -> DataFrame:
    """One row per input row: row (struct of the carried columns), doc_id, text_sha256, keep_id, group_size, kept.

    Null texts count as empty. Equal texts form a group and the row with the largest doc_id stays;
    a null doc_id is smaller than any other. Of rows that repeat both doc_id and text one stays.
    An empty table gives an empty result. carry names the columns to return in `row`; they may have
    any names.
    """
    carried = F.struct(*[F.col(f"`{c}`") for c in carry]) if carry else F.lit(0)
    # The sum is only a column of the result; it is never compared.
    left = docs.select(F.lit(0).cast("long").alias("parent"), F.col(f"`{doc_id}`").alias("id"), F.sha2(text_of(text).cast("binary"), 256).alias("sha"), text_of(text).cast("binary").alias("body"), carried.alias("row"))
    passed, reach, done = 0, FIRST_DIGIT, []
    while True:
        cut = left.withColumn("digit", F.substring("body", passed + 1, reach - passed))
        # Written, so that groups have numbers, and so that the join reads both sides from a shuffle of their own: only such a join can be split by size.
        split = cut.groupBy("parent", "digit").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("top")).where("n > 1")
        groups = written(split.withColumn("child", F.monotonically_increasing_id()), "radix-groups")
        ended = F.col("n").isNull() | (F.length("body") < reach)
        out = written(
            cut.join(groups, ["parent", "digit"], "left").select("id", "sha", "row", F.coalesce("n", F.lit(1)).cast("long").alias("n"), F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("top")).alias("top"), ended.alias("ended"), F.col("child").alias("parent"), F.when(~ended, F.col("body")).alias("body")),
            "radix",
        )
        discard(groups)
        done.append(out.where("ended").select("id", "sha", "row", "n", "top"))
        left = out.where("not ended").select("parent", "id", "sha", "body", "row")
        if left.isEmpty():
            break
        passed, reach = reach, reach * GROWTH
    all_rows = done[0]
    for more in done[1:]:
        all_rows = all_rows.unionByName(more)
    all_rows = one_of_ties(all_rows, F.col("id").eqNullSafe(F.col("top")), "id", "sha", "n")
    return all_rows.select("row", F.col("id").alias("doc_id"), F.col("top").alias("keep_id"), F.col("n").alias("group_size"), "kept", F.col("sha").alias("text_sha256"))


def keep_first(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    out = exact_dedup(docs, text, doc_id, carry=docs.columns)
    return out.where("kept").select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE = {
    "op9_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
}
QUERIES = {"op9_exact_dedup": op9_exact_dedup}
