"""Names and addresses of businesses as comparable columns.

Every function takes a Column and gives a Column of built-in expressions, so a whole normalization is
one projection inside code generation; no row leaves the JVM.
"""

from __future__ import annotations

import functools
import re
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import lexicon as lx

#: Anything but ASCII, Latin letters with accents, curly quotes and the degree and ordinal signs.
NATIVE = r"[^\x00-\x7FÀ-ɏ‘-‟°º]"


def _either(words: tuple[str, ...] | list[str]) -> str:
    """An alternation in the given order; spaces match any white space."""
    return "|".join(re.escape(w).replace(r"\ ", r"\s+") for w in words)


def _longest_first(words: tuple[str, ...]) -> str:
    return "|".join(sorted(words, key=lambda w: (-len(w), w)))


ALIAS = rf"(?U)^(.+?)\s+(?:{_either(lx.ALIAS_MARKERS)})\b[:\s]*(.+)$"
DOMAIN = rf"^[^a-z0-9]*(?:(?:{'|'.join(lx.DOMAIN_HONORIFICS)})\s+)?([a-z0-9\-]+)\.(?:{'|'.join(map(re.escape, lx.TLDS))})\b"
LEADING_HONORIFICS = rf"^(?:(?:{_longest_first(lx.HONORIFICS)})\s+)+"


@functools.cache
def _fold_tables() -> tuple[str, str, dict[str, str]]:
    """Characters whose compatibility form without marks is one other character, those characters, and the rest that are common in Latin text."""
    one_from, one_to, many = [], [], {}
    for code in [*range(0xA0, 0xD800), *range(0xF900, 0xFFFE)]:
        c = chr(code)
        plain = lx.fold(c)
        if plain == c or unicodedata.category(c) == "Mn":
            continue
        if len(plain) == 1:
            one_from.append(c)
            one_to.append(plain)
        elif code < 0x250 or 0x2000 <= code < 0x2150 or 0xFB00 <= code < 0xFB07:
            many[c] = plain
    return "".join(one_from), "".join(one_to), many


def strip_accents(c: Column) -> Column:
    """Compatibility decomposition without non-spacing marks. Of characters that decompose into several, those of Latin text are covered."""
    one_from, one_to, many = _fold_tables()
    c = F.regexp_replace(F.translate(c, one_from, one_to), r"\p{Mn}", "")
    spelt = c
    for k, v in many.items():
        spelt = F.replace(spelt, F.lit(k), F.lit(v))
    return F.when(c.rlike("[" + "".join(map(re.escape, many)) + "]"), spelt).otherwise(c)


def is_native(c: Column) -> Column:
    return F.coalesce(c.rlike(NATIVE), F.lit(False))


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def tokens(c: Column) -> Column:
    """Words of a string that spaces separate, without empty ones."""
    return F.filter(F.split(c, " "), lambda t: t != "")


def replace_tokens(c: Column, table: dict[str, str]) -> Column:
    """Every word by its entry in the table, once; a word whose entry is empty goes."""
    entries = F.create_map(*[F.lit(x) for k, v in table.items() if k != v for x in (k, v)])
    return F.array_join(F.filter(F.transform(F.split(c, " "), lambda t: F.coalesce(F.try_element_at(entries, t), t)), lambda t: t != ""), " ")


def lower_plain(c: Column) -> Column:
    """Lower case without accents, nor the letter that mis-read encodings leave behind."""
    return strip_accents(F.lower(F.replace(F.coalesce(c, F.lit("")), F.lit("Â"), F.lit(""))))


def drop_junk(c: Column) -> Column:
    """Without "(ID: 81649)", telephone numbers and "#12"."""
    for pattern in (r"(?U)\(?\bid\s*:?\s*\d+\)?", r"(?U)\s-\s*\d{7,}", r"(?U)\d{7,}", r"(?U)#\d+"):
        c = F.regexp_replace(c, pattern, " ")
    return c


def alias_main(c: Column) -> Column:
    """What follows an alias marker ("X dba Y": Y), or the whole."""
    after = F.regexp_extract(c, ALIAS, 2)
    return F.when(after == "", c).otherwise(after)


def alias_other(c: Column) -> Column:
    """What stands before an alias marker, or nothing."""
    return F.regexp_extract(c, ALIAS, 1)


def domain_label(c: Column) -> Column:
    """The label of a name written as a domain ("acmefreight.com": acmefreight), or nothing."""
    return F.regexp_extract(c, DOMAIN, 1)


def unleet(c: Column) -> Column:
    """Digits next to letters that stand for letters ("j0hnson"), as letters."""
    for digit, letter in lx.LEET:
        c = F.regexp_replace(c, f"([a-z]){digit}", f"$1{letter}")
        c = F.regexp_replace(c, f"{digit}([a-z])", f"{letter}$1")
    return c


def drop_honorifics(c: Column) -> Column:
    # "m s" leaves a space in front, which keeps what follows from counting as a leading honorific.
    return F.regexp_replace(F.regexp_replace(c, r"\b(m s)\b", ""), LEADING_HONORIFICS, "")


def letters_only(c: Column) -> Column:
    c = F.regexp_replace(c, r"(?U)\b(\d+)(st|nd|rd|th)\b", "$1")
    c = F.regexp_replace(F.replace(F.replace(c, F.lit("."), F.lit("")), F.lit("&"), F.lit(" and ")), r"[@$]", "a")
    return F.trim(F.regexp_replace(unleet(c), r"[^a-z0-9]+", " "))


def clean_name(c: Column) -> Column:
    """A name fragment with canonical legal forms and no leading honorifics."""
    return replace_tokens(drop_honorifics(letters_only(c)), lx.LEGAL_FORMS)


def legal_codes(c: Column) -> Column:
    """The legal forms of a clean name, sorted, once each."""
    codes = sorted({*lx.LEGAL_FORMS.values()})
    return F.array_join(F.array_sort(F.array_distinct(F.filter(F.split(c, " "), lambda t: t.isin(codes)))), " ")


def core_name(c: Column) -> Column:
    """A clean name without legal forms and country words."""
    drop = sorted({*lx.LEGAL_FORMS.values(), *lx.COUNTRY_WORDS})
    return F.array_join(F.filter(F.split(c, " "), lambda t: ~t.isin(drop) & (t != "")), " ")


def normalize_names(df: DataFrame, name: str = "business_name", rendered: str | None = None) -> DataFrame:
    """df with is_native, is_domain, name_full, name_alt, name_core, legal and name_nospace.

    rendered names a column with the name in Latin letters, where a dictionary of native words was applied.
    """
    df = df.withColumn("is_native", is_native(F.col(name))).withColumn("__n", drop_junk(lower_plain(F.col(rendered or name))))
    df = df.withColumns({"__main": alias_main(F.col("__n")), "__alt": alias_other(F.col("__n"))}).withColumn("__label", domain_label(F.col("__main")))
    df = df.withColumns({"is_domain": F.col("__label") != "", "name_full": clean_name(F.when(F.col("__label") != "", F.col("__label")).otherwise(F.col("__main"))), "name_alt": core_name(clean_name(F.col("__alt")))})
    df = df.withColumns({"__core": core_name(F.col("name_full")), "legal": legal_codes(F.col("name_full"))})
    df = df.withColumn("name_core", F.when(F.col("__core") != "", F.col("__core")).otherwise(F.col("name_full")))
    return df.withColumn("name_nospace", F.replace(F.col("name_core"), F.lit(" "), F.lit(""))).drop("__n", "__main", "__alt", "__label", "__core")


def clean_address(c: Column) -> Column:
    """Components between commas, with signs and words for nothing as spaces."""
    c = F.regexp_replace(lower_plain(c), "(?U)[^\\wऀ-෿,]+", " ")
    c = F.regexp_replace(c, r"\s*,\s*", ",")
    return F.regexp_replace(F.regexp_replace(c, r"(?U)\b(?:null|none|nil)\b", " "), r"(?U)\bn a\b", " ")


def _by_country(country: Column, by: dict[str, Column], other: Column) -> Column:
    out = None
    for k, v in by.items():
        out = F.when(F.lower(country) == k, v) if out is None else out.when(F.lower(country) == k, v)
    return out.otherwise(other)


def _state_map(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


def state_codes(address: Column, country: Column) -> Column:
    """Codes of the states that are whole components of a clean address, sorted, once each."""
    parts = F.split(address, ",")

    def codes(table: dict[str, str]) -> Column:
        entries = _state_map(table)
        found = F.filter(F.transform(parts, lambda p: F.try_element_at(entries, F.trim(p))), lambda x: x.isNotNull())
        return F.array_join(F.array_sort(F.array_distinct(found)), " ")

    return _by_country(country, {k: codes(t) for k, t in lx.state_tables().items()}, F.lit(""))


def without_states(address: Column, country: Column) -> Column:
    """The other components, with spaces between them."""
    parts = F.split(address, ",")

    def rest(table: dict[str, str]) -> Column:
        entries = _state_map(table)
        return F.array_join(F.filter(parts, lambda p: F.try_element_at(entries, F.trim(p)).isNull()), " ")

    return _by_country(country, {k: rest(t) for k, t in lx.state_tables().items()}, F.replace(address, F.lit(","), F.lit(" ")))


def split_numbers(c: Column) -> Column:
    """Ordinals as numbers, digits and letters apart, no underscores."""
    c = F.regexp_replace(c, r"(?U)\b(\d+)(?:st|nd|rd|th|er|eme|e)\b", "$1")
    c = F.regexp_replace(F.regexp_replace(c, r"(\d)([a-z])", "$1 $2"), r"([a-z])(\d)", "$1 $2")
    return squeeze(F.replace(c, F.lit("_"), F.lit(" ")))


def canonical_streets(c: Column, country: Column) -> Column:
    tables = lx.street_tables()
    return _by_country(country, {k: replace_tokens(c, t) for k, t in tables.items() if k}, replace_tokens(c, tables[""]))


def address_numbers(c: Column) -> Column:
    found = F.regexp_extract_all(c, F.lit(r"(?U)\b\d+\b"), F.lit(0))
    return F.array_join(F.transform(found, lambda n: F.when(F.ltrim(n, F.lit("0")) == "", "0").otherwise(F.ltrim(n, F.lit("0")))), " ")


def address_words(c: Column) -> Column:
    return squeeze(F.regexp_replace(c, r"(?U)\b\d+\b", " "))


def normalize_addresses(df: DataFrame, address: str = "business_address", country: str = "country") -> DataFrame:
    """df with state, addr_nums, addr and addr_null. A country without tables gets the general rules and no state."""
    where = F.coalesce(F.col(country), F.lit(""))
    df = df.withColumn("__a", clean_address(F.col(address)))
    df = df.withColumns({"state": state_codes(F.col("__a"), where), "__a": without_states(F.col("__a"), where)})
    df = df.withColumn("__a", canonical_streets(split_numbers(F.col("__a")), where))
    df = df.withColumns({"addr_nums": address_numbers(F.col("__a")), "addr": address_words(F.col("__a"))}).drop("__a")
    return df.withColumn("addr_null", (F.col("addr") == "") & (F.col("addr_nums") == ""))


def normalize_records(df: DataFrame, rendered: str | None = None) -> DataFrame:
    """Raw records (entity_id, business_name, business_address, country) with all normalized columns; raw text goes."""
    df = df.withColumn("src", F.expr("try_cast(substring(entity_id, 2, 1) AS tinyint)"))
    df = normalize_addresses(normalize_names(df, rendered=rendered))
    return df.drop("business_name", "business_address", *([rendered] if rendered else []))
