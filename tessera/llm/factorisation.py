"""Operator 2, a quality classifier: a factorisation machine on hashed words, structure and metadata.

A document is a sparse vector: hashed words with damped counts, structure statistics in steps, and
the size that the table states. The machine scores
    bias + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2),
all pairs of features in time linear in their number. It is trained here, on a bounded sample of
labelled rows, and then scores every whole text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_batches, table, text_bytes, worker_cache
from .quality_rules import MEASURES, measure

#: Buckets of hashed words, those of structure after them, rank, rows that are learned from at most, cached words.
WORD_BUCKETS, OTHER_BUCKETS, RANK, TRAIN_ROWS, CACHED_WORDS = 1 << 15, 1 << 10, 8, 8000, 400_000
WIDTH = WORD_BUCKETS + OTHER_BUCKETS
STEPS = np.array([0.002, 0.01, 0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0, 1.5, 2, 3, 4, 5, 6, 7, 8, 10, 14, 20])


def structure(text: bytes, size: int | None) -> np.ndarray:
    """The indices of a document's structure and metadata features, one for each statistic."""
    m = dict(zip(MEASURES, measure(text), strict=True))
    words, lines, letters = max(1, m["n_words"]), max(1, m["n_lines"]), max(1, m["n_letters"])
    rates = [m["word_chars"] / words, m["n_symbols"] / words, m["n_dup_lines"] / lines, m["n_repeat_words"] / words, m["n_ended"] / lines, m["n_upper"] / letters, m["n_marks"] / words, m["n_bars"] / words, m["n_letters"] / max(1, m["word_chars"]), np.log1p(m["n_words"]), np.log1p(words / lines), -1 if size is None or size < 0 else np.log1p(size)]
    steps = np.searchsorted(STEPS, rates, side="left")
    steps[-1] = len(STEPS) + 1 if rates[-1] < 0 else steps[-1]
    return WORD_BUCKETS + np.arange(len(rates)) * 32 + steps


def vector(text: bytes, size: int | None, known: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """(indices, values) of a document. known: a table of words' buckets, filled here."""
    words = text.lower().split()
    if len(known) > CACHED_WORDS:
        known.clear()
    for w in set(words).difference(known):
        known[w] = zlib.crc32(w) % WORD_BUCKETS
    buckets, counts = np.unique(np.fromiter(map(known.__getitem__, words), np.int32, len(words)), return_counts=True)
    values = np.log1p(counts)
    other = structure(text, size)
    scale = np.sqrt((values**2).sum()) or 1.0
    return np.concatenate((buckets, other)).astype(np.int32), np.concatenate((values / scale, np.full(len(other), 0.5))).astype(np.float32)


class Machine:
    """bias, weights (WIDTH) and factors (WIDTH x RANK)."""

    def __init__(self, seed: int = 2):
        self.bias, self.weights = 0.0, np.zeros(WIDTH, np.float32)
        self.factors = np.random.default_rng(seed).normal(0, 0.02, (WIDTH, RANK)).astype(np.float32)

    def raw(self, index: np.ndarray, value: np.ndarray) -> float:
        vx = self.factors[index] * value[:, None]
        total = vx.sum(axis=0)
        return float(self.bias + self.weights[index] @ value + 0.5 * (total @ total - (vx * vx).sum()))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = 6, rate: float = 0.1, shrink: float = 1e-4, seed: int = 3) -> Machine:
        """Logistic loss by stochastic gradients with a step of its own for each feature. Rows come in a seeded order."""
        if not rows:
            return self
        good = np.clip(np.mean([y for _, _, y in rows]), 0.01, 0.99)
        self.bias = float(np.log(good / (1 - good)))
        gw, gv, gb = np.full(WIDTH, 1e-2, np.float32), np.full((WIDTH, RANK), 1e-2, np.float32), 1e-2
        order = np.random.default_rng(seed)
        for _ in range(epochs):
            for k in order.permutation(len(rows)):
                index, value, y = rows[k]
                v = self.factors[index]
                vx = v * value[:, None]
                total = vx.sum(axis=0)
                score = self.bias + self.weights[index] @ value + 0.5 * (total @ total - (vx * vx).sum())
                error = 1 / (1 + np.exp(-np.clip(score, -30, 30))) - y
                g = error * value + shrink * self.weights[index]
                gw[index] += g * g
                self.weights[index] -= rate * g / np.sqrt(gw[index])
                g = error * (value[:, None] * (total - vx)) + shrink * v
                gv[index] += g * g
                self.factors[index] -= 0.2 * rate * g / np.sqrt(gv[index])
                gb += error * error
                self.bias -= rate * error / np.sqrt(gb)
        self.bias = float(self.bias)
        return self


def held_out(doc_id: Column) -> Column:
    """Rows never learned from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> Machine:
    """A machine fitted on at most `most` labelled rows, chosen by a hash of the id from those that may be learned from.

    Of documents that repeat an id, the least text counts. What comes to the driver is bounded by `most` vectors.
    """
    arrow_batches(docs.sparkSession)
    chosen = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id", F.lit("train")), "doc_id").limit(most)  # bounded, so it may be broadcast
    source = docs.select("doc_id", F.col("n_chars").cast("long").alias("size"), text_bytes().alias("body")).join(F.broadcast(chosen), "doc_id")
    source = source.groupBy("doc_id").agg(F.min(F.struct("body", "size", "quality")).alias("one")).select("one.size", "one.body", "one.quality")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = worker_cache("buckets")
        for b in batches:
            pairs = [vector(t, n, known) for t, n in zip(b.column("body").to_pylist(), b.column("size").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([i.tobytes() for i, _ in pairs], pa.binary()), pa.array([v.astype(np.float16).tobytes() for _, v in pairs], pa.binary()), b.column("quality")], names=["i", "v", "y"])

    rows = source.mapInArrow(run, T.StructType().add("i", "binary").add("v", "binary").add("y", "integer")).collect()
    # The order of arrival must not matter.
    made = sorted((bytes(r.i), bytes(r.v), r.y) for r in rows)
    return Machine().fit([(np.frombuffer(i, np.int32), np.frombuffer(v, np.float16).astype(np.float32), y) for i, v, y in made])


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id and score (0 to 1, higher: better) of every row of docs.

    A null text is an empty one and is scored by structure alone, a null size is a feature of its
    own. Repeated rows get equal scores. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    sent = spark.sparkContext.broadcast((machine.bias, machine.weights, machine.factors))
    source = docs.select("doc_id", F.col("n_chars").cast("long").alias("size"), text_bytes().alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, known = Machine(), worker_cache("buckets")
        own.bias, own.weights, own.factors = sent.value
        for b in batches:
            raw = [own.raw(*vector(t, n, known)) for t, n in zip(b.column("body").to_pylist(), b.column("size").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(np.array(raw, float), -30, 30))))], names=["doc_id", "score"])

    return source.mapInArrow(run, source.select("doc_id").schema.add("score", "double"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    machine = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, machine).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


QUERIES = {"op2_quality_classifier": op2_quality_classifier}
