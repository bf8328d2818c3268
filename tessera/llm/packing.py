"""Operator 3, best-fit packing in bulk-synchronous rounds.

Documents become token ids, and pieces of at most `capacity` tokens. Pieces and the gaps left in open
sequences are kept in a table of runs: pieces of one length with successive ranks, sequences of
successive numbers whose gaps have one size. Ranks are counted where the pieces are made and joined up
by a running sum over tasks, so the table is written without ever gathering the pieces.

A round takes the pieces of more than half of the greatest length left, and the gaps that can hold one:

- sort: pieces and gaps are dealt out by ranges of size and sorted within each.
- sweep: in every range at once, pieces from the longest on look for their successor, the least gap
  that holds them, which keeps what is left of it. Pieces that want the same gaps are told apart by rank.
- merge: a second sweep matches what the ranges left over, pieces of lower ranges with gaps of higher
  ones, and opens sequences for pieces that no gap holds.
- update: gaps shrink, the table is written, and the next round follows until no piece is left.

Sizes are whole numbers up to the capacity, so the table's rows depend on the capacity and not on how
many documents there are, and rounds are as many as the capacity has binary digits. A last join looks up
each piece's place by its length and rank, in blocks of ranks, so that no length is too frequent for a task.
"""

from __future__ import annotations

import bisect
import functools
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_batches, table, text_of, tokenizer_path, worker_cache, written

CAPACITY, CLOSING_ID, VOCABULARY = 2048, 0, "word_bpe_49k.json"
#: Entries in a worker's tables of known stretches and of words; a full table is emptied.
CACHED_STRETCHES, CACHED_WORDS = 250_000, 250_000
#: Letters that the vocabulary's rules turn to lower case one by one and keep together, then marks that they keep together.
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")


def _byte_signs() -> dict[int, str]:
    """How byte-level vocabularies write each byte: printable ones as themselves, the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


BYTE_SIGNS = _byte_signs()

#: Widths of the ranges of sizes, as a share of the capacity; ranks in a block of the last join.
RANGES, BLOCK = 16, 8192
PIECES = [("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType()), ("task", T.IntegerType()), ("place", T.LongType())]
#: A run. piece: n pieces of a size from the rank first on. gap: n gaps of a size in the sequences from first on. next: n sequences are open.
#: placed: n pieces of a size from the rank first on are in the sequences from sequence on, per in each, from the offset on.
RUNS = "kind string, size long, first long, n long, per long, sequence long, offset long"


def _stretch_ids(stretches: list[bytes], tokenizer) -> list[bytes]:
    """The ids of stretches of text without white space. Plain words go to the vocabulary's merges directly, all others through all its rules."""
    words, merge = worker_cache("words"), tokenizer.model.tokenize
    if len(words) > CACHED_WORDS:
        words.clear()

    def word(w: str) -> bytes:
        if (found := words.get(w)) is None:
            found = words[w] = array("I", [t.id for t in merge(w if w.isascii() else "".join(BYTE_SIGNS[b] for b in w.encode()))]).tobytes()
        return found

    out, others = [], []
    for stretch in stretches:
        text = stretch.decode("utf-8", "replace")
        if text.isalpha() and text.isascii():
            out.append(word(text.lower()))
        elif (m := PLAIN.fullmatch(text)) is not None:
            out.append(word(m[1].lower()) + word(m[2]) if m[2] else word(m[1].lower()))
        else:
            others.append((len(out), text))
            out.append(b"")
    for at in range(0, len(others), 4096):
        some = others[at : at + 4096]
        made = tokenizer.encode_batch_fast([t for _, t in some], add_special_tokens=False)
        for (k, _), e in zip(some, made, strict=True):
            out[k] = np.array(e.ids, "<u4").tobytes()
    return out


def encode(texts: pa.Array, tokenizer) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts one after another, where each text's begin and the last end), without special tokens added.

    The vocabulary's rules never join what white space separates, so ids are looked up by the
    stretches between it, once for each different stretch of the batch. Needs a vocabulary that
    drops white space, as word_bpe_49k.json does. texts: UTF-8 strings without nulls.
    """
    known: dict[bytes, bytes] = worker_cache("ids")
    parts = pc.ascii_split_whitespace(texts)
    coded = parts.flatten().dictionary_encode()
    every = coded.dictionary.view(pa.binary()).to_pylist()
    unknown = [w for w in every if w not in known]
    if len(known) + len(unknown) > CACHED_STRETCHES:
        known.clear()
        unknown = every
    known.update(zip(unknown, _stretch_ids(unknown, tokenizer), strict=True))
    own = [known[w] for w in every]
    ends = np.zeros(len(own) + 1, np.int64)
    np.cumsum([len(x) // 4 for x in own], out=ends[1:])
    lists = pa.LargeListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(own), "<u4")))
    taken = lists.take(coded.indices)
    # Ids before each stretch, at the places where texts begin.
    before = np.concatenate(([0], np.cumsum((ends[1:] - ends[:-1])[coded.indices.to_numpy()])))
    return taken.flatten().to_numpy(), before[parts.offsets.to_numpy() - parts.offsets[0].as_py()]


def tokenized(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY, closing_id: int = CLOSING_ID, vocabulary: str = VOCABULARY, with_ids: bool = False) -> DataFrame:
    """A row per piece: doc_id, PIECES, and the ids themselves if asked. place counts pieces of equal length within their task."""
    arrow_batches(docs.sparkSession)
    source = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), text_of(text).alias("body"))
    names = ["doc_id", *(n for n, _ in PIECES)]
    closing = np.array([closing_id], "<u4").tobytes()
    step = 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = worker_cache("tokenizers")
        if vocabulary not in tools:
            from tokenizers import Tokenizer

            tools.clear()
            worker_cache("ids").clear()
            worker_cache("words").clear()
            tools[vocabulary] = Tokenizer.from_file(tokenizer_path(vocabulary))
        task, places = TaskContext.get().partitionId(), {}
        for b in batches:
            ids, begin = encode(b.column("body"), tools[vocabulary])
            rows = []
            for doc, (first, end) in enumerate(zip(begin[:-1], begin[1:], strict=True)):
                own = ids[first:end].tobytes() + closing
                for k, at in enumerate(range(0, len(own), step)):
                    cut = own[at : at + step]
                    length = len(cut) // 4
                    place = places.get(length, 0)
                    places[length] = place + 1
                    rows.append((doc, k, at // 4, length, zlib.crc32(cut), task, place, cut))
            columns = [[r[i] for r in rows] for i in range(8)]
            types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            arrays = [b.column("doc_id").take(pa.array(columns[0], pa.int64())), *(pa.array(c, t) for c, t in zip(columns[1:], types, strict=False))]
            if with_ids:
                flat = pa.array(np.frombuffer(b"".join(columns[7]), "<u4").astype(np.int32))
                ends = np.concatenate(([0], np.cumsum(columns[3]))).astype(np.int32)
                arrays.append(pa.ListArray.from_arrays(pa.array(ends), flat))
            yield pa.RecordBatch.from_arrays(arrays, names=[*names, *["ids"] * with_ids])

    schema = T.StructType([source.schema["doc_id"], *[T.StructField(n, k) for n, k in PIECES], *[T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids])
    return source.mapInArrow(run, schema)


def sweep(runs: list[tuple], capacity: int, opens: bool) -> list[tuple]:
    """Runs (kind, size, first, n) with pieces matched, from the longest on, with the least gaps that hold them; opens: or else with new sequences.

    Rows as RUNS has them. Pieces of one length go on filling a gap that still holds them, as it is the least one then.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}  # size of the gap: runs (first sequence, how many)
    sizes: list[int] = []  # of the gaps, sorted
    placed: list[tuple] = []
    out = []
    sequences = sum(r[3] for r in runs if r[0] == "next")

    def keep(size: int, first: int, n: int) -> None:
        if size and n:
            if size not in gaps:
                bisect.insort(sizes, size)
                gaps[size] = []
            gaps[size].append((first, n))

    for _, size, first, n in sorted((r for r in runs if r[0] == "gap"), key=lambda r: r[2], reverse=True):
        keep(size, first, n)
    for _, length, rank, left in sorted((r for r in runs if r[0] == "piece"), key=lambda r: (-r[1], r[2])):
        while left:
            at = bisect.bisect_left(sizes, length)  # the successor
            if at < len(sizes):
                size = sizes[at]
                first, n = gaps[size].pop()
                if not gaps[size]:
                    del gaps[size], sizes[at]
            elif opens:
                size, first, n = capacity, sequences, -(-left // (capacity // length))
                sequences += n
            else:
                out.append(("piece", length, rank, left, 0, 0, 0))
                break
            per = size // length
            full = min(n, left // per)
            if full:
                placed.append(("placed", length, rank, full * per, per, first, capacity - size))
                keep(size - per * length, first, full)
                rank, left = rank + full * per, left - full * per
            if left and full < n:  # too few are left to fill a gap: the next one takes all of them
                placed.append(("placed", length, rank, left, left, first + full, capacity - size))
                keep(size - left * length, first + full, 1)
                rank, left, full = rank + left, 0, full + 1
            keep(size, first + full, n - full)
    out += [("gap", size, first, n, 0, 0, 0) for size, held in gaps.items() for first, n in held]
    return [*placed, *out, *[("next", 0, 0, sequences, 0, 0, 0)] * any(r[0] == "next" for r in runs)]


def swept(runs: DataFrame, key, capacity: int, opens: bool) -> DataFrame:
    """runs after one sweep within each group of the key, all at once. What is placed passes through."""

    def one(held: pd.DataFrame) -> pd.DataFrame:
        rows = [*held[["kind", "size", "first", "n"]].itertuples(index=False, name=None)]
        made = pd.DataFrame(sweep([r for r in rows if r[0] != "placed"], capacity, opens), columns=[x.split()[0] for x in RUNS.split(", ")])
        return pd.concat([made, held.loc[held["kind"] == "placed", made.columns]])

    return runs.withColumn("__key", key).groupBy("__key").applyInPandas(one, RUNS)


def placements(counts: DataFrame, capacity: int) -> DataFrame:
    """The placed runs of pieces counted by length (length, n)."""
    none = [F.lit(0).cast("long").alias(c) for c in ("per", "sequence", "offset")]
    zero = F.lit(0).cast("long")
    start = counts.select(F.lit("piece").alias("kind"), F.col("length").alias("size"), zero.alias("first"), "n", *none)
    first = counts.sparkSession.range(1).select(F.lit("next").alias("kind"), zero.alias("size"), zero.alias("first"), zero.alias("n"), *none)
    state, rounds = written(start.unionByName(first), "pack-runs"), []
    width, floor = -(-capacity // RANGES), capacity
    while floor:
        floor //= 2
        left = state.where("kind <> 'placed'")
        takes_part = (F.col("size") > floor) | (F.col("kind") == "next")
        ranged = swept(left.where(takes_part & (F.col("kind") != "next")), F.floor((F.col("size") - 1) / width), capacity, opens=False)
        merged = swept(ranged.unionByName(left.where("kind = 'next'")), zero, capacity, opens=True)
        state = written(merged.unionByName(left.where(~takes_part)), "pack-runs")
        rounds.append(state.where("kind = 'placed'"))
    return functools.reduce(DataFrame.unionByName, rounds)


def packed(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (a written table) with sequence_id and offset, without task and place."""
    held = written(pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n")), "pack-lengths")
    before = held.selectExpr("length", "task", "sum(n) OVER (PARTITION BY length ORDER BY task) - n AS before")
    runs = placements(held.groupBy("length").agg(F.sum("n").alias("n")), capacity)
    ranked = pieces.join(before, ["length", "task"]).withColumn("rank", F.col("before") + F.col("place")).withColumn("block", F.floor(F.col("rank") / BLOCK))
    blocks = runs.select("*", F.explode(F.sequence(F.floor(F.col("first") / BLOCK), F.floor((F.col("first") + F.col("n") - 1) / BLOCK))).alias("block"))
    r, p = ranked.alias("r"), blocks.alias("p")
    at = F.col("r.rank") - F.col("p.first")
    joined = r.join(p, (F.col("r.length") == F.col("p.size")) & (F.col("r.block") == F.col("p.block")) & at.between(0, F.col("p.n") - 1))
    kept = [F.col(f"r.{c}") for c in pieces.columns if c not in ("task", "place")]
    return joined.select(*kept, (F.col("p.sequence") + F.floor(at / F.col("p.per"))).alias("sequence_id"), (F.col("p.offset") + at % F.col("p.per") * F.col("r.length")).alias("offset"))


def pack_documents(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY, closing_id: int = CLOSING_ID, vocabulary: str = VOCABULARY, with_ids: bool = False) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, (ids,) sequence_id, offset.

    Only documents longer than the capacity are cut. A null text is empty: its piece is the closing
    id. A null doc_id stays null. Repeated rows are packed each on their own. An empty table gives an
    empty result; columns other than text and id are not read.
    """
    return packed(written(tokenized(docs, text, doc_id, capacity, closing_id, vocabulary, with_ids), "pieces"), capacity)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op3_packing": op3_packing}
