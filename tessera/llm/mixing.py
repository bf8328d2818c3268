"""Operator 8, mixing sources to target weights by hash-threshold histograms, native.

Every row draws a 60-bit hash of its id and text. A source's budget is a threshold on that hash, so
larger budgets contain smaller ones. The threshold is found without sorting: sum the sizes by source
and the next 12 bits of the hash, find by a running sum the bucket in which the budget ends, and look
only into that bucket, level by level, until it holds one hash. Then rows are filtered by their hash.
Where rows that repeat both id and text hold the end of a budget, they are told apart in the same way
by a hash of their place in the table; which of them are taken makes no difference.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_of, word_count, written

BITS, STEP = 60, 12
WEIGHTS = (5, 2, 1)
MOST = 3


def draw(*values: Column, seed: int = 8) -> Column:
    """A hash of the values, null as a value of its own, from 0 to 2**60 - 1."""
    return F.shiftrightunsigned(F.xxhash64(*[x for v in values for x in (v, v.isNull())], F.lit(seed)), 64 - BITS)


def ranked(rows: DataFrame, by: str) -> DataFrame:
    """rows with rank, from 0, in the order of a column (null last): by ranges, with the counts of the ranges before."""
    held = written(rows.orderBy(F.col(by).asc_nulls_last()).withColumn("range", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "mix-ranges")
    before = held.groupBy("range").agg(F.count(F.lit(1)).alias("n")).selectExpr("range", "sum(n) OVER (ORDER BY range) - n AS before")
    return held.join(before, "range").withColumn("rank", F.col("before") + F.col("place")).drop("range", "place", "before")


def targets(by_source: DataFrame, weights: tuple[int, ...], most: float) -> DataFrame:
    """by_source (source, source_size) with weight and target: shares of all sizes by weight, none above most times its source's size.

    The water level rises with each round until no more sources reach their limit; a round is one
    aggregation to a single row.
    """
    weight = f"element_at(array({', '.join(map(str, weights))}), cast(rank % {len(weights)} AS int) + 1)"
    weighed = written(ranked(by_source, "source").selectExpr("source", "source_size", f"cast({weight} AS double) AS weight"), "mix-sources")
    total, all_weight = weighed.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    level = total / all_weight if all_weight else 0.0
    while True:
        full = F.col("weight") * F.lit(level) > F.col("source_size") * F.lit(float(most))
        held, free = weighed.agg(F.coalesce(F.sum(F.when(full, F.col("source_size"))), F.lit(0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0))).first()
        rises = (total - most * held) / free if free else level
        if rises <= level:
            break
        level = rises
    limit = F.col("source_size") * F.lit(float(most))
    return weighed.withColumn("target", F.least(F.col("weight") * F.lit(level), limit))


def thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """budgets (source, rest and other columns) with threshold: rows of hash below it come nearest to rest.

    rows: source, size, h. Ends at whole rows: the row at the end of the budget is taken if at
    least half of it fits. tied: the one hash of several rows at the end, of which rows with a size of `more` are to be
    taken (null elsewhere); they are above the threshold.
    """
    same = F.col("r.source").eqNullSafe(F.col("b.source"))
    # low: the hashes below it fit; open: whether the bucket from low on is still to be split.
    state = written(budgets.select("source", F.col("rest").cast("double"), F.lit(0).cast("long").alias("low"), (F.col("rest") > 0).alias("open"), F.lit(0).cast("long").alias("threshold"), F.lit(None).cast("long").alias("tied")), "mix-budgets")
    left = rows
    for shift in range(BITS - STEP, -1, -STEP):
        open_ = state.where("open").select("source", "rest", "low")
        inside = F.shiftright(F.col("r.h"), shift + STEP) == F.shiftright(F.col("b.low"), shift + STEP)
        left = left.alias("r").join(open_.alias("b"), same & inside).select("r.source", "r.size", "r.h", "b.rest", "b.low")
        sums = left.groupBy("source", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"), F.min("h").alias("h0"), F.max("h").alias("h1"), F.first("rest").alias("rest"))
        ran = sums.selectExpr("*", "sum(size) OVER (PARTITION BY source ORDER BY bucket) - size AS before")
        end = ran.where("before <= rest AND before + size > rest").selectExpr("source AS s", "bucket", "size AS held", "rest - before AS more", "h0 = h1 AS single", "n > 1 AND h0 = h1 AS many", "h0")
        last = shift == 0
        width = 1 << shift
        joined = state.alias("r").join(end.alias("b"), F.col("r.source").eqNullSafe(F.col("b.s")), "left")
        closes = F.col("single") | F.lit(last)
        edge = F.col("bucket") * F.lit(width)
        takes = ~F.col("many") & (F.col("more") * 2 >= F.col("held"))
        state_next = joined.select(
            "source",
            F.when(F.col("bucket").isNotNull(), F.col("more")).otherwise(F.col("rest")).alias("rest"),
            F.when(F.col("bucket").isNotNull(), edge).otherwise(F.col("low")).alias("low"),
            # No bucket holds the end: the budget is the whole of what is left.
            (F.col("open") & F.col("bucket").isNotNull() & ~closes).alias("open"),
            F.when(~F.col("open"), F.col("threshold")).when(F.col("bucket").isNull(), F.col("low") + F.lit(1 << (shift + STEP))).otherwise(F.when(takes, edge + F.lit(width)).when(F.col("many"), F.col("h0")).otherwise(edge)).cast("long").alias("threshold"),
            F.when(F.col("many"), F.col("h0")).otherwise(F.col("tied")).alias("tied"),
        )
        state = written(state_next, "mix-state")
        if state.where("open").isEmpty():
            break
        left = left.select("source", "size", "h")
    return budgets.alias("r").join(state.alias("b"), same).select("r.*", "b.threshold", "b.tied", F.when(F.col("b.tied").isNotNull(), F.col("b.rest")).alias("more"))


def mix_plan(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """By source: source_size, target, copies (of every row), threshold (rows of hash below it once more), tied and
    second (rows of hash tied whose second hash is below it, too). rows: source, size, h, h2."""
    by_source = targets(rows.groupBy("source").agg(F.sum("size").cast("long").alias("source_size")), weights, most)
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    budgets = written(by_source.withColumn("copies", copies).withColumn("rest", F.col("target") - F.col("copies") * F.col("source_size")), "mix-budgets")
    plan = written(thresholds(rows, budgets), "mix-plan")
    tied = plan.where("tied IS NOT NULL").select("source", "tied", F.col("more").alias("rest"))
    if tied.isEmpty():
        return plan.withColumn("second", F.lit(0).cast("long"))
    same = F.col("r.source").eqNullSafe(F.col("b.source"))
    among = rows.alias("r").join(tied.alias("b"), same & (F.col("r.h") == F.col("b.tied"))).select("r.source", "r.size", F.col("r.h2").alias("h"))
    second = thresholds(written(among, "mix-tied"), tied.drop("tied")).select("source", F.col("threshold").alias("second"))
    return written(plan.alias("r").join(second.alias("b"), same, "left").select("r.*", F.coalesce("b.second", F.lit(0).cast("long")).alias("second")), "mix-plan")


def rows_of(docs: DataFrame, text: str, doc_id: str, source: str, *more: Column) -> DataFrame:
    """A written table of doc_id, source, size, h, h2 (of the row's place) and more columns."""
    h = draw(F.col(f"`{doc_id}`").cast("string"), text_of(text))
    placed = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").cast("string").alias("source"), word_count(text).alias("size"), h.alias("h"), F.monotonically_increasing_id().alias("at"), *more)
    return written(placed.withColumn("h2", draw(F.col("at"))).drop("at"), "mix-rows")


def taken_times(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows with source_size, target and copies (how often the mix takes the row)."""
    once_more = (F.col("r.h") < F.col("p.threshold")) | ((F.col("r.h") == F.col("p.tied")) & (F.col("r.h2") < F.col("p.second")))
    n = F.col("p.copies") + F.when(once_more, 1).otherwise(0)
    return rows.alias("r").join(plan.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source"))).select("r.*", "p.source_size", "p.target", n.alias("copies"))


def mix(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", weights: tuple[int, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken of every row of docs.

    A null text has size 0; null sources are one source, the last. Rows that repeat an id, or have none, are
    told apart by their texts, and equal rows by their place, so the taken words come near the target there too.
    An empty table gives an empty result; other columns are not read.
    """
    rows = rows_of(docs, text, doc_id, source)
    out = taken_times(rows, mix_plan(rows, weights, most))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def mixed(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", weights: tuple[int, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """The rows that the mix takes, each as often as it is taken, with the columns of docs."""
    doc = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    rows = rows_of(docs, text, doc_id, source)
    plan = mix_plan(rows, weights, most)
    if plan.where("tied IS NOT NULL").isEmpty():
        # The threshold of a source is all that a row needs: docs are read as they are.
        h = draw(F.col(f"`{doc_id}`").cast("string"), text_of(text))
        rows = docs.select(doc, F.col(f"`{source}`").cast("string").alias("source"), h.alias("h"), F.lit(0).cast("long").alias("h2"))
    else:
        # Places must be the same for the plan and for the rows.
        rows = rows_of(docs, text, doc_id, source, doc)
        plan = mix_plan(rows.drop("doc"), weights, most)
    out = taken_times(rows, plan).where("copies > 0")
    return out.select(F.explode(F.array_repeat("doc", F.col("copies"))).alias("doc")).select(*[F.col(f"doc.`{c}`").alias(c) for c in docs.columns])


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op8_mixing": op8_mixing}
