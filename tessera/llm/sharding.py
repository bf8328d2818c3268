"""Operator 5, sharding by a hierarchical weighted hash tree (law `key`), native.

Regions hold racks and racks hold shards. At each level a document draws, for every child of its
node, a uniform number hashed from its id and the child's name, and goes to the child with the least
-ln(u) / weight. A child's draw depends on nothing else, so when one child's weight grows only
that child gains rows, and rows move only within subtrees whose weights change.

A node's weight is the number of its shards. Here a new shard is a child of the root with weight 1
(its own region and rack until it is filled): at every level, rows move only into it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_of, written

#: Rows in one slot block, on average; a block is ranked by one task.
BLOCK_ROWS = 20_000


@dataclass(frozen=True)
class Node:
    """name is unique in the tree; shard is set at leaves. weight: of a leaf its own, of others the sum below."""

    name: str
    children: tuple[Node, ...] = field(default=())
    shard: int | None = None
    own_weight: float = 1.0

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own_weight


def tree(regions: list[list[int]], first_shard: int = 0) -> tuple[Node, ...]:
    """regions: for each region the number of shards in each of its racks. Shards are numbered in order."""
    out, shard = [], first_shard
    for r, racks in enumerate(regions):
        made = []
        for k, n in enumerate(racks):
            leaves = tuple(Node(f"{r}/{k}/{i}", shard=shard + i) for i in range(n))
            shard += n
            made.append(Node(f"{r}/{k}", leaves))
        out.append(Node(f"{r}", tuple(made)))
    return tuple(out)


def uniform(key: Column, name: str) -> Column:
    """In (0, 1), from 52 bits of a hash of the key and the name."""
    return (F.shiftrightunsigned(F.xxhash64(key, F.lit(name)), 12).cast("double") + 0.5) / F.lit(float(2**52))


def descend(key: Column, nodes: tuple[Node, ...]) -> Column:
    """The shard that the key reaches from these siblings."""
    nodes = tuple(n for n in nodes if n.weight > 0)
    below = [descend(key, n.children) if n.children else F.lit(n.shard) for n in nodes]
    if len(nodes) == 1:
        return below[0]
    draws = [-F.log(uniform(key, n.name)) / F.lit(float(n.weight)) for n in nodes]
    best, chosen = F.least(*draws), None
    for draw, shard in zip(draws[:-1], below[:-1], strict=True):
        chosen = F.when(draw == best, shard) if chosen is None else chosen.when(draw == best, shard)
    return chosen.otherwise(below[-1])


def shard_documents(docs: DataFrame, regions: list[list[int]], text: str = "text", doc_id: str = "doc_id", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row.

    Null texts are empty. A null doc_id is a key like any other. Repeated ids share a shard (the id
    and the shards alone decide) and get slots in the order of size and sum; rows equal in all three
    are interchangeable. An empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    nodes = tree(regions)
    count = sum(map(sum, regions))
    grown = (*nodes, Node("new", shard=count))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    body = text_of(text).cast("binary")
    # Draws of the levels that both trees share are made once: a row leaves only if the new child wins at the root.
    root = [-F.log(uniform(key, n.name)) / F.lit(float(n.weight)) for n in grown]
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), (F.length(body) + 8).cast("long").alias("size"), F.crc32(body).alias("text_crc32"))
    rows = rows.withColumn("shard", descend(key, nodes).cast("int")).withColumn("grown_shard", F.when(root[-1] < F.least(*root[:-1]), F.lit(count)).otherwise(F.col("shard")).cast("int"))
    rows = written(rows, "shards")
    # Slots: blocks by a hash, ranked each by one task; a block's first slot comes from the counts of those before it.
    total = rows.count()
    blocks = max(1, math.ceil(total / count / block_rows))
    rows = rows.withColumn("block", F.pmod(F.xxhash64(key, F.lit("block"), "size", "text_crc32"), F.lit(blocks)).cast("int"))
    at = rows.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("n"))
    at = at.selectExpr("shard", "block", "sum(n) OVER (PARTITION BY shard ORDER BY block) - n AS before")
    ranked = rows.selectExpr("*", "row_number() OVER (PARTITION BY shard, block ORDER BY doc_id, size, text_crc32) - 1 AS place")
    out = ranked.join(at, ["shard", "block"])
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("before") + F.col("place")).cast("long").alias("slot"), "grown_shard")


#: 24 shards: three regions of two racks of four.
REGIONS = [[4, 4], [4, 4], [4, 4]]


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), REGIONS)


QUERIES = {"op5_sharding": op5_sharding}
