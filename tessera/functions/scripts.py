"""Names in native scripts: a dictionary learned from matched names, and a romanizer for the rest."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import read_text, write_text
from .textnorm import strip_accents

NON_LATIN = r"[^\x00-\x7FÀ-ɏ‘-‟]"
SEPARATORS = r"""[\s.,\-()\[\]&/'"!#:;]+"""
MIN_COUNT, MIN_SHARE = 2, 0.5


def latin_tokens(name: Column) -> Column:
    return F.regexp_extract_all(F.replace(strip_accents(F.lower(name)), F.lit("."), F.lit("")), F.lit("[a-z0-9]+"), F.lit(0))


def native_tokens(name: Column) -> Column:
    return F.filter(F.split(name, SEPARATORS), lambda t: t != "")


def fit_dictionary(pairs: DataFrame, min_count: int = MIN_COUNT, min_share: float = MIN_SHARE) -> DataFrame:
    """native, latin, from pairs (latin, native) of names: words align by place where both have as many.

    A native word is entered with its most frequent Latin word (the first in order on ties), if that
    was seen often enough and is at least half of all.
    """
    both = pairs.select(latin_tokens(F.col("latin")).alias("l"), native_tokens(F.col("native")).alias("n")).where(F.size("l") == F.size("n"))
    words = both.select(F.explode(F.arrays_zip("n", "l")).alias("x")).select(F.col("x.n").alias("native"), F.col("x.l").alias("latin")).where(F.col("native").rlike(NON_LATIN))
    counted = words.groupBy("native", "latin").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("native").orderBy(F.desc("n"), "latin")
    ranked = counted.withColumns({"r": F.row_number().over(order), "total": F.sum("n").over(Window.partitionBy("native"))})
    return ranked.where((F.col("r") == 1) & (F.col("n") >= min_count) & (F.col("n") / F.col("total") >= min_share)).select("native", "latin")


def training_pairs(truth: DataFrame, s1: DataFrame, targets: DataFrame, name: str = "business_name") -> DataFrame:
    """(latin, native) names of true pairs whose target is native. s1 without the records of the validation fold."""
    native = targets.where(F.col(name).rlike(NON_LATIN)).select(F.col("entity_id").alias("t"), F.col(name).alias("native"))
    return truth.join(native, "t").join(s1.select(F.col("entity_id").alias("s1"), F.col(name).alias("latin")), "s1").select("latin", "native")


def _roman(c: str) -> str:
    """A letter's sound by its Unicode name: "DEVANAGARI LETTER KA" is ka, a vowel sign replaces the inherent vowel."""
    if c.isascii():
        return c
    words = unicodedata.name(c, "").split()
    for kind in ("LETTER", "SIGN", "DIGIT"):
        if kind in words:
            sound = words[words.index(kind) + 1 :]
            if kind == "DIGIT":
                return str(unicodedata.digit(c, ""))
            return "" if not sound or sound[-1] in ("VIRAMA", "NUKTA") else {"ANUSVARA": "n", "VISARGA": "h", "CANDRABINDU": "n"}.get(sound[-1], sound[-1].lower())
    plain = unicodedata.normalize("NFKD", c)
    return "".join(x for x in plain if x.isascii())


def romanize(word: str) -> str:
    out: list[str] = []
    for c in word:
        name, sound = unicodedata.name(c, ""), _roman(c)
        if out and out[-1].endswith("a") and len(out[-1]) > 1 and ("VOWEL SIGN" in name or "VIRAMA" in name):
            out[-1] = out[-1][:-1]
        out.append(sound)
    return "".join(out).lower()


def _romanized(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for words in batches:
        yield words.map(romanize)


romanize_udf = F.pandas_udf(_romanized, T.StringType())


def translate_names(df: DataFrame, dictionary: DataFrame, key: str = "entity_id", name: str = "business_name", out: str = "rendered") -> DataFrame:
    """df with the name in Latin letters: each native word by the dictionary, or romanized. Latin names never leave the JVM."""
    is_native = F.coalesce(F.col(name).rlike(NON_LATIN), F.lit(False))
    words = df.where(is_native).select(key, F.posexplode(native_tokens(F.col(name))).alias("at", "native"))
    known = words.join(dictionary, "native", "left")
    hard = F.col("latin").isNull() & F.col("native").rlike(NON_LATIN)
    easy = known.where(~hard).select(key, "at", F.coalesce("latin", "native").alias("word"))
    made = known.where(hard).select(key, "at", romanize_udf("native").alias("word"))
    rendered = easy.unionByName(made).groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("__r"))
    return df.join(rendered, key, "left").withColumn(out, F.coalesce("__r", name)).drop("__r")


def coverage(names: DataFrame, dictionary: DataFrame, name: str = "native") -> DataFrame:
    """One row: words, known, coverage of the native words of names."""
    words = names.select(F.explode(native_tokens(F.col(name))).alias("native")).where(F.col("native").rlike(NON_LATIN))
    joined = words.join(dictionary.withColumn("hit", F.lit(1)), "native", "left")
    return joined.agg(F.count(F.lit(1)).alias("words"), F.coalesce(F.sum("hit"), F.lit(0)).cast("long").alias("known")).withColumn("coverage", F.coalesce(F.try_divide("known", "words"), F.lit(0.0)))


def save_dictionary(dictionary: DataFrame, path: str) -> None:
    """A JSON file in any file system that Spark writes; the dictionary is a vocabulary, far smaller than the records."""
    words = {r.native: r.latin for r in dictionary.orderBy("native").toLocalIterator()}
    write_text(dictionary.sparkSession, path, json.dumps(words, ensure_ascii=False, sort_keys=True))


def load_dictionary(spark: SparkSession, path: str) -> DataFrame:
    return spark.createDataFrame([*json.loads(read_text(spark, path)).items()], "native string, latin string")
