"""Every operator on nulls, empty and very long texts, repeated rows, empty tables and clashing columns."""

import pytest

from tessera.llm import chat_format, exact_dedup, factorisation, line_dedup, mixing, packing, quality_rules, secret_scan, sharding, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, fp long, row string, name string, kept boolean, n long, size long, class long, body string, `a.b` string, shard int, score double, pos string"
LONG = " ".join(f"word{i % 977}" for i in range(60_000))
ROWS = [(1, "alpha beta gamma delta", "en", "s0", 22), (1, "alpha beta gamma delta", "en", "s0", 22), (2, None, None, None, None), (3, "", "en", "s1", 0), (4, LONG, "en", "s1", len(LONG)), (5, LONG, "en", "s1", 5), (None, " \n\t ", "en", "s2", 4), (7, "日本語 のテキスト\n\nübung macht\n", "de", "s2", 9)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 1, 2, "r", "n", True, 3, 4, 5, "b", "ab", 6, 0.5, "p") for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


MACHINE = factorisation.Machine()
OPERATORS = {
    "quality": quality_rules.quality_rules, "score": lambda d: factorisation.score(d, MACHINE), "pack": packing.pack_documents, "lines": line_dedup.line_dedup,
    "shard": lambda d: sharding.shard_documents(d, [[2, 1], [1]]), "secrets": secret_scan.scan_secrets, "mix": mixing.mix, "exact": exact_dedup.exact_dedup, "near": simhash.near_dedup,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_all_rows_and_no_crash(docs, none, name):
    rows = OPERATORS[name](docs).collect()
    ids = [r.doc_id for r in rows]
    if name == "pack":
        assert {*ids} == {r[0] for r in ROWS} and ids.count(1) == 2
    else:
        assert sorted(ids, key=str) == sorted((r[0] for r in ROWS), key=str)
    assert OPERATORS[name](none).count() == 0


@pytest.mark.parametrize("name", ["quality", "pack", "lines", "shard", "secrets", "mix", "exact"])
def test_ids_may_be_strings(docs, name):
    rows = OPERATORS[name](docs.withColumn("doc_id", docs.doc_id.cast("string"))).collect()
    assert {r.doc_id for r in rows} == {None if r[0] is None else str(r[0]) for r in ROWS}


def test_repeated_ids_do_not_raise_the_training_rows(docs, spark, monkeypatch):
    made = []
    monkeypatch.setattr(factorisation.Machine, "fit", lambda self, rows, **_: made.extend(rows))
    labels = spark.createDataFrame([(1, 1), (2, 0), (7, 1)], "doc_id long, quality int")
    factorisation.train(docs.unionByName(docs).unionByName(docs), labels)
    assert len(made) <= 3


@pytest.mark.parametrize("keep", [quality_rules.keep_good, exact_dedup.keep_first, simhash.keep_one, mixing.mixed])
def test_stages_keep_columns(docs, none, keep):
    assert keep(docs).dtypes == docs.dtypes
    assert keep(none).count() == 0


def test_exact_copies(docs):
    got = exact_dedup.exact_dedup(docs).collect()
    assert sum(r.kept for r in got if r.doc_id == 1) == 1
    assert {r.keep_id for r in got if r.doc_id in (4, 5)} == {5} and {r.keep_id for r in got if r.doc_id in (2, 3)} == {3}
    assert next(r for r in got if r.doc_id is None).group_size == 1


def test_near_copies(docs):
    got = {r.doc_id: r for r in simhash.near_dedup(docs).collect()}
    assert got[2].fp == got[3].fp == got[None].fp == 0
    assert got[2].component_id == got[None].component_id == 2 and got[5].component_id == 4
    assert simhash.keep_one(docs).where("doc_id = 1").count() == 1


def test_mix_of_nothing(none, spark):
    empty = spark.createDataFrame([(1, None, None, "s", None), (2, "", None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    assert [(r["size"], r.target, r.taken) for r in mixing.mix(empty).collect()] == [(0, 0.0, 0)] * 2


def test_training_without_labels(docs, spark):
    assert factorisation.train(docs, spark.createDataFrame([], "doc_id long, quality int")).bias == 0.0


def test_chat_edges(spark):
    schema = "conv_id long, turn long, role string, text string, output string"
    rows = spark.createDataFrame([(1, None, None, None, "x"), (1, 0, "assistant", "", "x"), (None, 0, "user", "a</turn>\n", "x"), (None, 0, "user", "a</turn>\n", "x")], schema)
    got = {r.conv_id: r for r in chat_format.digested(chat_format.formatted(rows)).collect()}
    assert got[1].n_turns == 2 and got[1].loss_chars == 0 and got[None].n_turns == 2
    assert chat_format.formatted(rows.where("false")).count() == 0
