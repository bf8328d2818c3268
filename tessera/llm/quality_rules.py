"""Operator 1, quality rules as weak supervision.

One pass over the texts measures each document. Rules turn the measures into votes: 1 (good), -1
(bad) or 0 (abstains). Expectation-maximisation over the counts of the vote patterns (at most
3**rules of them, however many documents) estimates for each rule how often it votes good on good
documents and bad on bad ones, and the share of good documents; a document is kept when the
posterior probability of being good is at least one half. Two hard limits of the base come first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batches, table, text_bytes, written

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_ended", "n_upper", "n_letters", "n_marks", "n_bars")
SYMBOLS = [bytes([c]) for c in b"#*$%&|<>"]
UPPER = bytes(range(65, 91))
LETTERS = UPPER + bytes(range(97, 123)) + bytes(range(128, 256))
#: How a line of prose ends, as bytes: . ! ? : ; and closing quotes and brackets.
ENDS = (b".", b"!", b"?", b":", b";", b'"', b"'", b")", b"\xe2\x80\x9d", b"\xe2\x80\xa6")
WINDOW = 5


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a five-word window found twice or more, the first finding included."""
    windows = list(zip(*(words[i:] for i in range(WINDOW)), strict=False))
    if len(set(windows)) == len(windows):
        return 0
    seen, twice = set(), set()
    for w in windows:
        (twice if w in seen else seen).add(w)
    n, reach = 0, 0
    for i, w in enumerate(windows):
        if w in twice:
            n += i + WINDOW - max(reach, i)
            reach = i + WINDOW
    return n


def measure(text: bytes) -> tuple[int, ...]:
    """The values of MEASURES for a text, in that order. bytes.split() cuts at exactly the white space of the contract."""
    words = text.split()
    n_bytes = sum(map(len, words))
    continued = len(text) - len(text.translate(None, bytes(range(128, 192))))
    seen, dup, lines, ended = set(), 0, 0, 0
    for line in text.split(b"\n"):
        bare = line.strip()
        if bare:
            lines += 1
            ended += bare.endswith(ENDS)
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    letters = len(text) - len(text.translate(None, LETTERS))
    upper = len(text) - len(text.translate(None, UPPER))
    return len(words), n_bytes - continued, sum(map(text.count, SYMBOLS)), dup, repeat_words(words), lines, ended, upper, letters - continued, text.count(b"!!"), text.count(b" | ")


def measured(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", carry: list[str] | None = None) -> DataFrame:
    """doc_id, row (struct of the carried columns, if any) and the measures of every row."""
    arrow_batches(docs.sparkSession)
    # The carried columns go around Python as they are.
    more = [F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row")] if carry else []
    source = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), text_bytes(text).alias("body"), *more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = [n for n in b.schema.names if n != "body"]
            values = [measure(x.as_py()) for x in b.column("body")]
            columns = [pa.array([v[i] for v in values], pa.int64()) for i in range(len(MEASURES))]
            yield pa.RecordBatch.from_arrays([b.column(n) for n in names] + columns, names=names + list(MEASURES))

    schema = source.drop("body").schema
    for m in MEASURES:
        schema = schema.add(m, "long")
    return source.mapInArrow(run, schema)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _vote(value: Column, good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rules() -> dict[str, Column]:
    """Each rule's vote, from the measures. A rule abstains where its measure says little."""

    def share(a: str, b: str) -> Column:
        return F.col(a) / F.greatest(F.col(b), F.lit(1))

    length, symbols, dup, again = share("word_chars", "n_words"), share("n_symbols", "n_words"), share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words")
    ended, upper, marks, bars, letters = share("n_ended", "n_lines"), share("n_upper", "n_letters"), share("n_marks", "n_words"), share("n_bars", "n_words"), share("n_letters", "word_chars")
    return {
        "word_length": _vote(length, length.between(3, 9), (length < 2) | (length > 14)),
        "symbols": _vote(symbols, symbols <= 0.02, symbols > 0.1),
        "dup_lines": _vote(dup, dup <= 0.05, dup > 0.3),
        "repeats": _vote(again, again <= 0.05, again > 0.15),
        "line_ends": _vote(ended, ended >= 0.7, ended < 0.3),
        "capitals": _vote(upper, upper <= 0.15, upper > 0.4),
        "marks": _vote(marks, marks <= 0.01, marks > 0.1),
        "bars": _vote(bars, bars <= 0.01, bars > 0.1),
        "letters": _vote(letters, letters >= 0.85, letters < 0.7),
    }


def fit(patterns: np.ndarray, counts: np.ndarray, rounds: int = 2000) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """EM for a hidden good/bad label: share of good, then each rule's log odds for a good vote, a bad vote, none.

    patterns: one row per vote pattern; counts: how many documents have it. Each rule has, for good
    and for bad documents, its chances to vote good, bad and to abstain. A few imagined
    documents keep chances off 0 and 1, and tell the two labels apart: rules are right at first.
    """
    n_rules = patterns.shape[1]
    prior = np.empty((2, n_rules, 3))
    prior[0] = [2.0, 1.0, 2.0]  # imagined votes on bad documents (bad in one way, good in others): bad, abstain, good
    prior[1] = [0.02, 0.5, 5.0]
    hot = np.stack([patterns == v for v in (-1, 0, 1)], axis=2).astype(float)
    good, chance = 0.8, prior / prior.sum(axis=2, keepdims=True)
    for _ in range(rounds):
        logs = np.einsum("prv,yrv->py", hot, np.log(chance)) + np.log([1 - good, good])
        post = np.exp(logs - logs.max(axis=1, keepdims=True))
        post /= post.sum(axis=1, keepdims=True)
        weight = post * counts[:, None]
        before = good, chance
        good = float((weight[:, 1].sum() + 8) / (counts.sum() + 10))
        chance = np.einsum("py,prv->yrv", weight, hot) + prior
        chance /= chance.sum(axis=2, keepdims=True)
        if max(abs(good - before[0]), np.abs(chance - before[1]).max()) < 1e-9:
            break
    odds = np.log(chance[1] / chance[0])
    return good, odds[:, 2], odds[:, 0], odds[:, 1]


def judged(measures: DataFrame) -> DataFrame:
    """measures with votes (string), quality (posterior), base_failed and kept."""
    votes = rules()
    names = list(votes)
    text = F.concat_ws(",", *[v.cast("string") for v in votes.values()])
    voted = measures.withColumn("votes", text)
    # One row per pattern: at most 3**9, a bound that no data can raise.
    seen = voted.where(~base_failed()).groupBy("votes").agg(F.count(F.lit(1)).alias("n")).collect()
    patterns = np.array([[int(x) for x in r.votes.split(",")] for r in seen], dtype=int).reshape(-1, len(names))
    good, up, down, none = fit(patterns, np.array([r.n for r in seen], dtype=float))
    score = F.lit(float(np.log(good / (1 - good))))
    for name, a, b, c in zip(names, up, down, none, strict=True):
        score = score + F.when(votes[name] == 1, float(a)).when(votes[name] == -1, float(b)).otherwise(float(c))
    quality = 1 / (1 + F.exp(-score))
    failed = base_failed()
    return voted.withColumn("quality", quality).withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("quality") >= 0.5))


def quality_rules(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", carry: list[str] | None = None) -> DataFrame:
    """doc_id, row (if carry names columns), the measures, votes, quality, base_failed, kept of every row of docs.

    A null text has no words and fails the base, as an empty one does. Repeated rows are judged
    alike. An empty table gives an empty result. A very long text is measured whole.
    """
    return judged(written(measured(docs, text, doc_id, carry), "rules"))


def keep_good(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of docs that the rules keep, with all their columns."""
    out = quality_rules(docs, text, doc_id, carry=docs.columns)
    return out.where("kept").select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "votes", F.round("quality", 6).alias("quality"))


QUERIES = {"op1_quality_rules": op1_quality_rules}
