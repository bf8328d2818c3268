"""Operator 10, SimHash near-dedup by the generalised pigeonhole principle.

A document's fingerprint has a bit set where over half the hashes of its three-word shingles have
it. Two fingerprints link if at most `reach` of their 64 bits differ. With bits cut into m
partitions and a threshold t_i for each, two fingerprints within reach agree in some partition up
to its threshold whenever the thresholds add up to reach - m + 1 (a threshold of -1 drops a
partition). Bits that go together are put in one partition. Dynamic programming finds the
thresholds of the least cost, from counts of candidates estimated on a bounded sample of the
fingerprints; every fingerprint is then indexed, probed and verified.

Equal fingerprints are one class, so copies cost nothing. A bucket with more than `bucket`
classes is not paired up: its classes, and those that probe it, are matched exactly in another way.
Two fingerprints differ in at most two bits if and only if some 64-bit string differs from each in
at most one, so each class names the 65 strings around it and those that share one are linked, a
group that never has more than 65 classes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import components
from .common import arrow_batches, discard, one_of_ties, table, text_bytes, written

#: Fingerprints that the thresholds are fitted on; classes paired up in one bucket; bits that may differ.
SAMPLE, BUCKET, REACH = 20_000, 64, 2
SHINGLE, SEED, CHUNK = 3, 42, 1 << 15


def fingerprint(text: bytes) -> int:
    """The fingerprint of a text's UTF-8 bytes, as an unsigned number."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        return digest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - SHINGLE + 1
    counts = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        a, b = starts[at : min(n, at + CHUNK)].tolist(), ends[at + SHINGLE - 1 : min(n, at + CHUNK) + SHINGLE - 1].tolist()
        hashes = np.array([digest(joined[s:e], SEED) for s, e in zip(a, b, strict=True)], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return sum(1 << i for i in np.flatnonzero(2 * counts > n).tolist())


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", carry: list[str] | None = None) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) and row (struct of the carried columns, if any) of every row."""
    arrow_batches(docs.sparkSession)
    more = [F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row")] if carry else []
    source = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), *more, text_bytes(text).alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([fingerprint(x.as_py()) for x in b.column("body")], dtype=np.uint64).view(np.int64)
            names = [n for n in b.schema.names if n != "body"]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(found)], names=[*names, "fp"])

    return source.mapInArrow(run, source.drop("body").schema.add("fp", "long"))


def partitions(bits: np.ndarray, m: int) -> list[list[int]]:
    """64 bits in m groups of nearly equal size, each grown from the bit most tied to others by those most tied to the group."""
    width = bits.shape[1]
    if len(bits) > 1:
        centred = bits - bits.mean(axis=0)
        spread = np.sqrt((centred**2).sum(axis=0))
        tie = np.abs(centred.T @ centred) / np.maximum(np.outer(spread, spread), 1e-9)
    else:
        tie = np.zeros((width, width))
    np.fill_diagonal(tie, 0)
    free, out = list(range(width)), []
    for k in range(m):
        size = round(width * (k + 1) / m) - round(width * k / m)
        first = max(free, key=lambda i: (tie[i, free].sum(), -i))
        group = [first]
        free.remove(first)
        while len(group) < size:
            best = max(free, key=lambda i: (tie[i, group].sum(), -i))
            group.append(best)
            free.remove(best)
        out.append(sorted(group))
    return out


def _within(bits: np.ndarray, reach: int) -> list[float]:
    """The chance that two fingerprints differ in at most 0, 1, ... of these bits, were the bits independent."""
    p = bits.mean(axis=0) if len(bits) else np.full(bits.shape[1], 0.5)
    exactly = np.zeros(reach + 1)
    exactly[0] = 1.0
    for differ in 2 * p * (1 - p):
        exactly = exactly * (1 - differ) + np.concatenate(([0.0], exactly[:-1])) * differ
    return np.cumsum(exactly).tolist()


def masks(width_bits: list[int], upto: int) -> list[int]:
    """All ways to flip at most upto of these bits, as signed 64-bit masks."""
    found = [sum(1 << b for b in some) for k in range(upto + 1) for some in combinations(width_bits, k)]
    return [x - (1 << 64) if x >= 1 << 63 else x for x in found]


def allocate(sample: np.ndarray, n: int, reach: int = REACH, most: int = 4, pair_cost: float = 1.0, probe_cost: float = 1.0) -> tuple[list[tuple[list[int], int]], float]:
    """The partitions to probe, with thresholds, for n fingerprints like the sample (uint64), and their estimated cost.

    For each number of partitions, best[s] is the least cost of thresholds that add up to s over
    the partitions seen so far.
    """
    bits = np.unpackbits(sample.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(float)
    some = sample[: max(1, 4_000_000 // max(1, len(sample)))]  # a few against all
    winner: tuple[list[tuple[list[int], int]], float] | None = None
    for m in range(1, most + 1):
        groups = partitions(bits, m)
        best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for group in groups:
            mask = np.uint64(sum(1 << b for b in group))
            apart = np.bitwise_count((some[:, None] ^ sample[None, :]) & mask) if len(sample) else np.zeros((1, 1))
            pairs = max(1, some.size * sample.size - some.size)
            chance = _within(bits[:, group], reach)
            following: dict[int, tuple[float, list[int]]] = {}
            for t in range(-1, reach + 1):
                # Seen in the sample, or where that is too small to see it, as if bits were independent.
                near = max((int((apart <= t).sum()) - some.size) / pairs, chance[t]) if t >= 0 else 0.0
                cost = 0.0 if t < 0 else probe_cost * n * sum(math.comb(len(group), k) for k in range(t + 1)) + pair_cost * n * n / 2 * near
                for s, (c, chosen) in best.items():
                    if s + t not in following or c + cost < following[s + t][0]:
                        following[s + t] = (c + cost, [*chosen, t])
            best = following
        if (goal := reach - m + 1) in best and (winner is None or best[goal][0] < winner[1]):
            cost, chosen = best[goal]
            winner = ([(g, t) for g, t in zip(groups, chosen, strict=True) if t >= 0], cost)
    assert winner
    return winner


def links(classes: DataFrame, reach: int = REACH, sample: int = SAMPLE, bucket: int = BUCKET) -> DataFrame:
    """Edges (u, v) between different fingerprints of classes (fp), enough to connect all that are within reach."""
    assert reach == 2, "the exact way for large buckets is written for two bits"
    n = classes.count()
    taken = classes.orderBy(F.xxhash64("fp"), "fp").limit(sample).collect()
    plan, _ = allocate(np.array([r.fp for r in taken], dtype=np.int64).view(np.uint64), n, reach)

    def keys(part: int, group: list[int], flips: int) -> Column:
        own = masks([*group], 0)[0]  # no flip
        whole = sum(1 << b for b in group)
        whole = whole - (1 << 64) if whole >= 1 << 63 else whole
        key = F.col("fp").bitwiseAND(F.lit(whole))
        flipped = [key.bitwiseXOR(F.lit(x)) for x in (masks(group, flips) if flips else [own])]
        return F.array(*[F.struct(F.lit(part).alias("part"), x.alias("key")) for x in flipped])

    index = classes.select("fp", F.explode(F.concat(*[keys(i, g, 0) for i, (g, _) in enumerate(plan)])).alias("k")).select("fp", "k.*")
    probing = any(t for _, t in plan)
    probes = classes.select("fp", F.explode(F.concat(*[keys(i, g, t) for i, (g, t) in enumerate(plan)])).alias("k")).select("fp", "k.*") if probing else index
    full = written(index.groupBy("part", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bucket).select("part", "key"), "buckets")
    any_full = not full.isEmpty()
    small = index.join(full, ["part", "key"], "left_anti") if any_full else index
    small_probes = probes.join(full, ["part", "key"], "left_anti") if any_full and probing else small if not probing else probes
    near = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= reach
    apart = F.col("a.fp") != F.col("b.fp") if probing else F.col("a.fp") < F.col("b.fp")
    joined = small_probes.alias("a").join(small.alias("b"), (F.col("a.part") == F.col("b.part")) & (F.col("a.key") == F.col("b.key")) & near & apart)
    edges = joined.select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))
    if any_full:
        dense = probes.join(full, ["part", "key"], "left_semi").select("fp").distinct()
        around = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(x)) for x in masks(list(range(64)), 1)[1:]])
        balls = dense.select("fp", F.explode(around).alias("z")).groupBy("z").agg(F.collect_list("fp").alias("all")).where(F.size("all") > 1)
        edges = edges.unionByName(balls.select(F.explode("all").alias("u"), F.array_min("all").alias("v")).where("u <> v"))
    return edges


def near_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", carry: list[str] | None = None) -> DataFrame:
    """doc_id, fp, component_id (the least doc_id reachable by links) of every row of docs, and row if carry names columns.

    A null text is an empty one and has fingerprint zero, linked like any other. A null doc_id is
    no component's id unless all its ids are null. Repeated rows share fingerprint and component. An
    empty table gives an empty result. Very long texts are hashed whole, in chunks.
    """
    rows = written(fingerprints(docs, text, doc_id, carry), "fingerprints")
    classes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    roots = written(components(links(classes.select("fp"))), "roots")
    named = classes.join(roots, classes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    # Only classes that a link touches need another id than their own least.
    linked = written(named.join(roots.select("node"), F.col("fp") == F.col("node"), "left_semi").join(ids, "root").select("fp", "component_id"), "linked")
    final = written(classes.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")), "components")
    for t in (classes, roots, linked):
        discard(t)
    return rows.join(final, "fp")


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of docs that stay, one of each component, with all their columns."""
    out = near_dedup(docs, text, doc_id, carry=docs.columns)
    out = one_of_ties(out, F.col("doc_id").eqNullSafe(F.col("component_id")), "component_id")
    return out.where("kept").select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op10_simhash": op10_simhash}
