"""Files, stages, streams and the whole linkage."""

import inspect
import json

import pytest
from pyspark.sql import functions as F

from tessera.functions import scripts
from tessera.operators import alternatives, decide, metrics, models, retrieve, vectors
from tessera.plans import linkage, registry
from tessera.sources import fixtures, stages, tsv

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def raw(spark):
    return fixtures.raw_records(spark, SMALL).cache()


def test_tsv_round_trip(spark, tmp_path):
    path = tmp_path / "in.tsv"
    path.write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\t"A" Ltd, x\t\tUS\nS1-2\té\tb\tFrance\n', encoding="utf-8")
    rows = tsv.load_source(spark, str(path)).orderBy("entity_id").collect()
    assert [tuple(r) for r in rows] == [("S1-1", '"A" Ltd, x', None, "US"), ("S1-2", "é", "b", "France")]


def test_lists_round_trip(spark, tmp_path):
    ids = spark.createDataFrame([("S1-1",), ("S1-2",)], "s1 string")
    links = spark.createDataFrame([("S1-1", "S3-9"), ("S1-1", "S2-4")], "s1 string, t string")
    out = str(tmp_path / "lists")
    tsv.write_tsv(tsv.id_lists(ids, links, "matched_entity_ids").coalesce(1), out)
    text = "".join(p.read_text() for p in (tmp_path / "lists").glob("part*"))
    assert sorted(text.splitlines()) == ["S1-1\tS2-4,S3-9", "S1-2\t", "source1_entity_id\tmatched_entity_ids"]
    back = tsv.explode_truth(tsv.read_tsv(spark, out, tsv.TRUTH))
    assert {tuple(r) for r in back.collect()} == {("S1-1", "S2-4"), ("S1-1", "S3-9")}


def test_bundle(spark, tmp_path):
    import zipfile

    rows = spark.createDataFrame([("S1-1", "S2-4,S3-9"), ("é", None)], "source1_entity_id string, matched_entity_ids string").coalesce(1)
    tsv.write_bundle({"matches.tsv": rows, "none.tsv": rows.where("false")}, str(tmp_path / "out.zip"))
    with zipfile.ZipFile(tmp_path / "out.zip") as z:
        assert {n: z.read(n).decode() for n in z.namelist()} == {"matches.tsv": "source1_entity_id\tmatched_entity_ids\nS1-1\tS2-4,S3-9\né\t\n", "none.tsv": "source1_entity_id\tmatched_entity_ids\n"}


def test_calibration_is_monotone(spark):
    from tessera.operators import alternatives

    rows = [(c, i / 40, int((i * 7) % 40 < i)) for c in ("a", "b") for i in range(40)]
    got = alternatives.calibrated(spark.createDataFrame(rows, "country string, p double, y int"), "country").collect()
    for c in ("a", "b"):
        own = [r.calibrated for r in sorted((r for r in got if r.country == c), key=lambda r: r.p)]
        assert own == sorted(own) and len(own) == 40 and abs(sum(own) - sum(r.y for r in got if r.country == c)) < 1e-6


def test_stage_runs_once(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    for mark in ("a", "a", "b"):
        assert stages.stage(spark, str(tmp_path / "t"), mark, make).count() == 3
    assert len(made) == 2
    assert stages.fingerprint(make, {"x": 1}) != stages.fingerprint(make, {"x": 2})


def test_dictionary(spark, tmp_path):
    pairs = spark.createDataFrame([("indo products", "इंडो प्रोडक्ट्स"), ("Indo Mills", "इंडो मिल्स"), ("other", "एक दो")], "latin string, native string")
    d = scripts.fit_dictionary(pairs)
    assert [tuple(r) for r in d.collect()] == [("इंडो", "indo")]
    scripts.save_dictionary(d, str(tmp_path / "d.json"))
    assert json.loads((tmp_path / "d.json").read_text()) == {"इंडो": "indo"}
    names = spark.createDataFrame([("1", "इंडो कमल"), ("2", "Plain, Name"), ("3", None)], "entity_id string, business_name string")
    got = {r.entity_id: r.rendered for r in scripts.translate_names(names, scripts.load_dictionary(spark, str(tmp_path / "d.json"))).collect()}
    assert got == {"1": "indo kamala", "2": "Plain, Name", "3": None}


def test_trigrams(spark):
    df = spark.createDataFrame([("ab",), ("abcd",), ("",)], "x string")
    assert [r[0] for r in df.select(vectors.trigrams(F.col("x"))).collect()] == [[], ["abc", "bcd"], []]


def test_ties_do_not_depend_on_partitions(spark):
    rows = [(f"S1-{i % 7}", f"S2-{i}", 0.5) for i in range(60)]
    df = spark.createDataFrame(rows, "s1 string, t string, name_cos double")
    got = [{tuple(r) for r in retrieve.top_k(df.repartition(n), "name_cos", "s1", 2, "k").collect()} for n in (1, 5, 13)]
    assert got[0] == got[1] == got[2] and len(got[0]) == 14


def test_top_k_is_pruned_before_the_shuffle(spark):
    df = spark.range(1000).selectExpr("cast(id % 50 AS string) AS s1", "cast(id AS string) AS t", "rand(1) AS c")
    plan = retrieve.top_k(df, "c", "s1", 2, "k")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_no_cartesian_products(spark, raw):
    s1, targets = linkage.prepare(raw)
    plan = retrieve.channel_scores(s1, targets)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_fixed_linkage(spark, raw):
    matches = linkage.fixed_matches(raw)
    truth = fixtures.truth(raw)
    f = metrics.macro_f(matches, truth, raw.where("entity_id LIKE 'S1-%'").selectExpr("entity_id AS s1")).first()[0]
    assert f > 0.5
    assert matches.groupBy("t").count().where("count > 1").isEmpty()


def test_train_and_predict(spark, raw, tmp_path):
    few = linkage.Settings(pruner_rounds=10, matcher_rounds=20, patience=20)
    report = linkage.train(raw, fixtures.truth(raw), str(tmp_path), few)
    assert report["val_f"] > 0.75 and report["threshold"] in decide.GRID
    cands, matches, checks = linkage.predict(raw, str(tmp_path))
    assert checks.where("violations > 0").isEmpty() and checks.count() == 8
    assert matches.count() == cands.count() == raw.where("entity_id LIKE 'S1-%'").count()
    assert models.load(f"{tmp_path}/matcher").getNumTrees > 0


def test_boosting_has_patience(spark):
    assert models.best_round([5, 4, 4.5, 3, 3.5, 3.2, 2], 2) == (4, True) and models.best_round([5, 4, 4.5, 3], 2) == (4, False)
    rows = [(float(i % 20), float(i % 3), int(i % 20 + 9 * (i % 3) > 17), i % 5 == 4) for i in range(400)]
    df = spark.createDataFrame(rows, "a double, b double, y int, is_tune boolean")
    long = models.train_matcher(df, ["a", "b"], rounds=12, patience=12)
    short = models.first_trees(long, 5)
    assert 5 < long.getNumTrees <= 12 and short.getNumTrees == 5 and short.treeWeights == long.treeWeights[:5]
    assert models.score(df, short, ["a", "b"], "p").where("p > 0.5 AND y = 1").count() > 0


def test_training_has_its_full_rounds_and_rows():
    rounds = [inspect.signature(f).parameters["rounds"].default for f in (models.train_pruner, models.train_matcher)]
    assert rounds == [200, 600] and inspect.signature(models.train_matcher).parameters["patience"].default == 50
    s = linkage.Settings()
    assert (s.most_training, s.pruner_rounds, s.matcher_rounds, s.patience) == (400_000, 200, 600, 50)


def test_streaming(spark, raw, tmp_path):
    from tessera.streaming import incremental

    raw.where("entity_id LIKE 'S2-%'").drop("k").write.parquet(str(tmp_path / "in"))
    s1, _ = linkage.prepare(raw)
    stream = spark.readStream.schema(tsv.RECORD).parquet(str(tmp_path / "in"))
    seen = []
    q = incremental.link_stream(incremental.normalized_stream(stream), s1, lambda df, n: seen.append(df.count()), str(tmp_path / "ck"))
    q.processAllAvailable()
    q.stop()
    assert sum(seen) > 0


def test_every_query_has_a_callable():
    assert {*registry.oracle_sql()} <= {*registry.queries()}


def test_prefix_join_gives_copies_a_row_each(spark):
    names = {**{f"S1-{i:03}": "blue ring bako" for i in range(40)}, **{f"S2-{i:03}": "bako ring blue" for i in range(40)}}
    names |= {"S1-900": "blue ring", "S2-900": "blue bolt ring ring", "S3-900": "blue gear", "S3-901": "", "S3-902": None}
    df = spark.createDataFrame([(k, "US", v) for k, v in names.items()], "entity_id string, country string, name string")
    members, links = alternatives.prefix_join(df, F.filter(F.split("name", " "), lambda w: w != ""), ["country"])
    of, rows = {r.entity_id: r.class_id for r in members.collect()}, links.collect()
    assert len(of) == 83 and len(set(of.values())) == 4 and len(rows) <= 4 * 4
    got = {(s1, t, round(r.jaccard, 6)) for r in rows for s1 in of if s1[1] == "1" and of[s1] == r.class_id for t in of if t[1] != "1" and of[t] == r.linked_id}
    sets = {k: set(v.split()) for k, v in names.items() if v}
    want = {(s1, t, round(len(sets[s1] & sets[t]) / len(sets[s1] | sets[t]), 6)) for s1 in sets if s1[1] == "1" for t in sets if t[1] != "1"}
    assert got == {x for x in want if x[2] >= 0.5}


def test_retrieval_scores_copies_once(spark):
    rows = [(f"S{src}-{k:04}", src, "US", "" if src > 1 and k % 10 == 9 else "nc", f"{'abcdefgh'[k % 8]}{'klmnop'[k % 6]}or{'uvwxyz'[k % 5]}an", f"elm {'pqrs'[k % 4]} road", str(k % 7)) for src, n in ((1, 120), (2, 240)) for k in range(n)]
    rows += [(f"S{src}-9{k:03}", src, "US", "nc", "zzyzx", "elm p road", "77") for src, n in ((1, 20), (2, 30)) for k in range(n)]
    df = spark.createDataFrame(rows, "entity_id string, src int, country string, block string, name_nospace string, addr string, addr_nums string").cache()
    s1, targets, sizes = df.where("src = 1"), df.where("src > 1"), {}

    def save(df, name):
        sizes[name] = sizes.get(name, 0) + (df := df.cache()).count()
        return df

    got = retrieve.retrieve(s1, targets, save).cache()
    scores, lost = retrieve.channel_scores(s1, targets).cache(), retrieve.fallback_scores(s1, targets).cache()
    lists = [retrieve.top_k(scores, col, by, ks[c], f"{c}_{d}") for d, by, ks in (("fwd", "s1", retrieve.FORWARD), ("rev", "t", retrieve.REVERSE)) for c, col in retrieve.CHANNELS.items()]
    same = retrieve.merged(lists, retrieve.RANKS).join(scores, ["s1", "t"])
    best = retrieve.merged([retrieve.top_k(lost, "name_cos", "t", 2, "name_rev")], retrieve.RANKS).join(lost, ["s1", "t"])

    def told(pairs, same_block):
        pairs = pairs.withColumn("addr_cos", F.col("addr_cos") if same_block else F.lit(None).cast("double"))
        return {tuple(r) for r in pairs.select("s1", "t", *retrieve.RANKS, F.round("name_cos", 6), F.round("addr_cos", 6)).collect()}

    assert told(got.where("same_block"), True) == told(same, True) and told(got.where("NOT same_block"), False) == told(best, False)
    assert got.where("same_block").count() and got.where("NOT same_block").count()
    # The copies alone are 600 pairs of records, and one of classes.
    assert scores.where("s1 LIKE 'S1-9%' AND t LIKE 'S2-9%' AND name_cos > 0.9").count() == 600
    assert sizes["scores"] <= scores.count() - 599
