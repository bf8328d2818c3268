"""Operator 4, line dedup by an exact set-similarity join, native.

A line is the set of its lower-case words. A line goes if an earlier line, by doc_id and place in the
text, has a set whose Jaccard similarity is at least 0.8. Lines with equal sets are one class, known
by its first line; all others of the class go. Classes of at least four words (smaller ones match
only equal sets) are joined:

- order: words from rare to frequent, by counts over all words of all lines. Counts are kept for
  2**20 hash buckets of words, a size that does not grow. A word is a number: six bits of rarity, then
  57 bits of its hash. Equal sets are equal in 128 bits hashed from the whole sorted set.
- prefix: two sets this similar share one of the first n - ceil(0.8 n) + 1 words of both. From 96 words
  on, prefixes are longer by n / 32 words, and as many more must be shared.
- position and length: the words from a shared one on must suffice in both sets, which also bounds
  how far sizes differ.
- bits: each word flips one of 64 bits of its set. Sets that match differ in few words, so in few bits.
- verify: the similarity of the pairs that are left is computed from the words of their lines.

Whether a line goes depends on whether any earlier one matches, so many alike are not paired up: where
many classes have a word in their prefixes, a first round compares classes only with the earliest under
each such word, and what it removes takes no part, as the later line, in the second round over all.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, table, text_of, written

SIMILARITY_PERCENT, BUCKETS, GROUP = 80, 1 << 20, 1 << 10
#: Bits of a word's hash that its number keeps below the rarity; counts are told apart in half powers of two.
HASH_BITS, LEVELS = 57, 64
#: Classes with a word in their prefixes from which the first round looks at them, and the rarity of words in so many lines.
LARGE, OFTEN = 1024, 21
#: How many times fewer bits may differ in the first round, which need not find all.
STRICT = 4 / 3
#: Sets of so many words have prefixes longer by one for each so many words.
LONG, LONGER = 96, 32
#: For columns of hashes, which neither a dictionary nor compression makes smaller.
PLAIN = {"parquet.enable.dictionary": "false"}
FAST_MAP = "spark.sql.codegen.aggregate.fastHashMap.capacityBit"


def plain(docs: DataFrame, text: str, *more: Column) -> DataFrame:
    """body, the text in lower case with spaces for the other white space within lines, and more columns."""
    low = docs.select(F.lower(text_of(text)).alias("body"), *more)
    other = functools.reduce(operator.or_, (F.contains("body", F.lit(c)) for c in "\t\r\x0b\x0c"))
    return low.withColumn("body", F.when(other, F.translate("body", "\t\x0b\x0c\r", "    ")).otherwise(F.col("body")))


def lines_of(docs: DataFrame) -> DataFrame:
    """id, line, body of every line with a word. docs: id, body."""
    return docs.select("id", F.posexplode(F.split("body", "\n")).alias("line", "body")).where("trim(body) <> ''")


def hashes(line: Column) -> Column:
    """The different words of a plain line, each as its hash."""
    return F.array_remove(F.array_distinct(F.transform(F.split(line, " "), lambda w: F.xxhash64(w))), F.xxhash64(F.lit("")))


def bucket(hashed: Column) -> Column:
    return hashed.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")


def rarity(hashed: DataFrame) -> DataFrame:
    """levels, in one row: the rarity of each bucket of words, by the number of lines with a word in it. hashed: words."""
    spark = hashed.sparkSession
    counted = hashed.select(F.explode("words").alias("w")).groupBy(bucket(F.col("w")).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    level = F.least(F.lit(LEVELS - 1), F.floor(2 * F.log2("n")) + 1).cast("tinyint")
    none = spark.range(BUCKETS).select(F.col("id").cast("int").alias("b"), F.lit(0).cast("tinyint").alias("level"))
    each = counted.where("n > 1").select("b", level.alias("level")).unionByName(none).groupBy("b").agg(F.max("level").alias("level"))
    groups = each.groupBy(F.floor(F.col("b") / GROUP).cast("int").alias("g")).agg(F.sort_array(F.collect_list(F.struct("b", "level")))["level"].alias("levels"))
    before = spark.conf.get(FAST_MAP)
    spark.conf.set(FAST_MAP, str(BUCKETS.bit_length() - 1))  # room for all buckets in the faster of a task's two tables
    try:
        return written(groups.agg(F.flatten(F.sort_array(F.collect_list(F.struct("g", "levels")))["levels"]).alias("levels")), "line-rarity")
    finally:
        spark.conf.set(FAST_MAP, before)


def extra(n: Column) -> Column:
    """Words that sets of n words must share in their prefixes besides one."""
    return F.when(n >= LONG, F.floor(n / LONGER).cast("int")).otherwise(0)


def parsed(docs: DataFrame) -> DataFrame:
    """id, n_lines, line, worded, words of every line with a word (worded) and of the first line of every text. docs: id, body."""
    breaks = F.octet_length("body") - F.octet_length(F.replace("body", F.lit("\n"), F.lit("")))  # a list of lines would get a filter that splits all texts again
    lines = docs.withColumn("n_lines", breaks + 1).select("id", "n_lines", F.posexplode(F.split("body", "\n")).alias("line", "body")).withColumn("worded", F.trim("body") != "")
    words = hashes(F.col("body")).alias("words")
    return written(lines.where("worded OR line = 0").select("id", "n_lines", "line", "worded", words), "line-hashes", "uncompressed", **PLAIN)


def classes(hashed: DataFrame) -> DataFrame:
    """id, line (of the first line, which name the class), n, bits, prefix (of the sorted words). hashed: id, line, worded, words."""
    levels = rarity(hashed)

    def number(h: Column) -> Column:
        level = F.coalesce(F.get("levels", bucket(h)), F.lit(0).cast("tinyint")).cast("long")
        return F.shiftleft(level, HASH_BITS).bitwiseXOR(F.shiftrightunsigned(h, 64 - HASH_BITS))

    # A scalar subquery, so that plans, of which the driver keeps many copies, do not hold the levels themselves.
    known = hashed.where("worded").select("id", "line", "words", levels.scalar().alias("levels"))
    words = known.select("id", "line", F.sort_array(F.transform("words", number)).alias("words"))
    bits = F.aggregate("words", F.lit(0).cast("long"), lambda held, w: held.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), w.bitwiseAND(F.lit(63)).cast("int"))))
    n = F.size("words")
    prefix = n - F.ceil(n * F.lit(SIMILARITY_PERCENT) / 100 - 1e-9).cast("int") + 1 + extra(n)
    first = F.struct("id", "line", n.alias("n"), bits.alias("bits"), F.slice("words", F.lit(1), prefix).alias("prefix"))
    signed = words.select(F.xxhash64("words").alias("d"), F.xxhash64(F.lit(1), "words").alias("e"), first.alias("first"))
    return written(signed.groupBy("d", "e").agg(F.min("first").alias("first")).select("first.*"), "line-classes", "snappy")


def prefixes(found: DataFrame, *more: str) -> DataFrame:
    """id, line, n, bits, word, room (words from it on) of the prefix of every class of at least four words. Words seen once match nothing."""
    index = found.where("n >= 4").select("id", "line", "n", "bits", *more, F.posexplode("prefix").alias("at", "word"))
    return index.where(F.col("word") >= F.lit(2 << HASH_BITS)).withColumn("room", F.col("n") - F.col("at")).drop("at")


def differ() -> Column:
    """Bits in which classes a and b differ."""
    return F.bit_count(F.col("a.bits").bitwiseXOR(F.col("b.bits")))


def alike(strict: float = 1.0) -> Column:
    """Whether a is an earlier class than b and passes the filter on bits; strict: how many times fewer bits may differ."""
    before = (F.col("a.id") < F.col("b.id")) | ((F.col("a.id") == F.col("b.id")) & (F.col("a.line") < F.col("b.line")))
    return before & (differ() * int(strict * (100 + SIMILARITY_PERCENT)) <= (F.col("a.n") + F.col("b.n")) * (100 - SIMILARITY_PERCENT))


def confirmed(found: DataFrame, words: DataFrame) -> DataFrame:
    """id, line: each b of pairs found that is similar enough to its a, by their words."""
    for x in "ab":
        found = found.join(words.select(F.col("id").alias(f"{x}_id"), F.col("line").alias(f"{x}_line"), F.col("words").alias(x)), [f"{x}_id", f"{x}_line"])
    common = F.size(F.array_intersect("a", "b"))
    similar = common * 100 >= (F.size("a") + F.size("b") - common) * SIMILARITY_PERCENT
    return written(found.where(similar).select(F.col("b_id").alias("id"), F.col("b_line").alias("line")).distinct(), "line-matches")


def matched(joined: DataFrame, least: Column, rows: DataFrame, every: bool = True) -> DataFrame:
    """id, line: each b that is similar enough to an a of those it is joined with in `least` rows or more. rows: id, text.

    First each b is compared with the a nearest to it in bits, then (if every a counts) those left with all others.
    """
    keys = {f"{x}_{c}": F.col(f"{x}.{c}") for x in "ab" for c in ("id", "line")}
    found = written(joined.groupBy(*[v.alias(k) for k, v in keys.items()]).agg(F.min(differ()).alias("apart"), F.count(F.lit(1)).alias("shared"), F.min(least).alias("least")).where("shared >= least").drop("shared", "least"), "line-pairs")
    nearest = found.groupBy("b_id", "b_line").agg(*[F.min_by(c, "apart").alias(c) for c in ("a_id", "a_line")])
    asked = found if every else written(nearest, "line-nearest")
    named = [asked.select(F.col(f"{x}_id").alias("id"), F.col(f"{x}_line").alias("line")) for x in "ab"]
    wanted = named[0].unionByName(named[1])
    if every:
        # Texts are dealt out by id at every size; those that are wanted are looked up, so texts need no sorting.
        by_id = wanted.groupBy("id").agg(F.collect_set("line").alias("wanted"))
        some = plain(rows.join(by_id.hint("shuffle_hash"), "id"), "text", F.col("id"), F.col("wanted"))
        numbered_lines = F.transform(F.split("body", "\n"), lambda body, line: F.struct(line.alias("line"), body.alias("body")))
        asked_for = some.select("id", F.inline(F.filter(numbered_lines, lambda x: F.array_contains("wanted", x["line"]))))
    else:
        asked_for = lines_of(plain(rows.join(written(wanted.select("id").distinct(), "line-wanted"), "id", "left_semi"), "text", F.col("id")))
    words = written(asked_for.select("id", "line", hashes(F.col("body")).alias("words")), "line-words")
    first = confirmed(nearest if every else asked, words)
    if not every:
        discard(words)
        return first
    rest = found.join(first.select(F.col("id").alias("b_id"), F.col("line").alias("b_line")), ["b_id", "b_line"], "left_anti")
    second = confirmed(rest, words)
    for t in (found, words):
        discard(t)
    return first.unionByName(second)


def removed_early(found: DataFrame, rows: DataFrame) -> DataFrame | None:
    """id, line: classes that match the earliest under a word of theirs which LARGE classes or more have; None if there is no such word."""
    frequent = prefixes(found).where(F.col("word") >= F.lit(OFTEN << HASH_BITS)).drop("room")
    earliest = frequent.groupBy("word").agg(F.count(F.lit(1)).alias("held"), F.min("id").alias("id"), *[F.min_by(c, "id").alias(c) for c in ("line", "n", "bits")])
    earliest = written(earliest.where(F.col("held") >= LARGE).drop("held"), "line-earliest")
    if earliest.isEmpty():
        return None
    return matched(frequent.alias("b").join(earliest.alias("a"), (F.col("a.word") == F.col("b.word")) & alike(STRICT)), F.lit(1), rows, every=False)


def removed_classes(found: DataFrame, rows: DataFrame) -> DataFrame:
    """id, line: classes whose first line matches an earlier line. rows: id, text."""
    gone = removed_early(found, rows)
    flagged = found.withColumn("gone", F.lit(False)) if gone is None else found.join(gone.withColumn("gone", F.lit(True)), ["id", "line"], "left")
    # Both sides are one table, so that they share a shuffle: the room of what is gone, negative, suffices in no b.
    index = prefixes(flagged, "gone").withColumn("room", F.when(F.col("gone"), -F.col("room")).otherwise(F.col("room"))).drop("gone")
    more = F.least(extra(F.col("a.n")), extra(F.col("b.n")))
    # Of the words that must be shared, the last has all the others before it.
    suffices = (F.least(F.abs("a.room"), F.col("b.room")) + more) * (100 + SIMILARITY_PERCENT) >= (F.col("a.n") + F.col("b.n")) * SIMILARITY_PERCENT
    both = index.alias("a").join(index.alias("b"), (F.col("a.word") == F.col("b.word")) & alike() & suffices)
    late = matched(both, more + 1, rows)
    return late if gone is None else gone.unionByName(late)


def numbered(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """doc_id, text, id: a whole number for each row, in the order of doc_id (null first), then of text. Whole and different doc_ids are taken as they are."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    kind = rows.schema["doc_id"].dataType.typeName()
    if kind in ("byte", "short", "integer", "long") and rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR doc_id IS NULL").isEmpty():
        return rows.withColumn("id", F.col("doc_id").cast("long"))
    return written(rows.orderBy(F.col("doc_id").asc_nulls_first(), "text").withColumn("id", F.monotonically_increasing_id()), "line-rows")


def line_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_lines, n_removed, removed (numbers of the lines that go, in order) of every row of docs.

    Lines without a word stay. A null text has one line, without a word. A null doc_id is before all
    others, which may be numbers or strings; of rows that repeat a doc_id, the lesser text is earlier,
    and of equal rows any. An empty table gives an empty result; other columns are not read.
    """
    rows = numbered(docs, text, doc_id)
    hashed = parsed(plain(rows, "text", F.col("id")))
    lines = written(hashed.drop("words"), "line-places", "snappy")
    found = classes(hashed)
    discard(hashed)
    stay = found.select("id", "line").join(removed_classes(found, rows.select("id", "text")), ["id", "line"], "left_anti")
    every = lines.unionByName(stay.withColumn("stays", F.lit(True)), allowMissingColumns=True)
    held = [F.collect_list(F.when(F.col(c), F.col("line"))).alias(c) for c in ("worded", "stays")]
    out = rows.select("id", "doc_id").join(every.groupBy("id").agg(F.max("n_lines").cast("long").alias("n_lines"), *held), "id")
    removed = F.array_sort(F.array_except("worded", "stays"))
    return out.select("doc_id", "n_lines", F.size(removed).cast("long").alias("n_removed"), removed.alias("removed"))


def without_lines(docs: DataFrame, decided: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs, whose ids are different, with the lines of decided (from line_dedup) taken out of the text."""
    gone = decided.select(F.col("doc_id").alias("__id"), F.col("removed").alias("__gone"))
    kept = F.filter(F.split(text_of(text), "\n"), lambda b, i: ~F.array_contains("__gone", i))
    return docs.join(gone, F.col(f"`{doc_id}`").eqNullSafe(F.col("__id"))).withColumn(text, F.array_join(kept, "\n")).select(*[f"`{c}`" for c in docs.columns])


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.array_join(F.transform("removed", lambda i: i.cast("string")), ",").alias("removed"))


QUERIES = {"op4_line_dedup": op4_line_dedup}
