"""All queries of the library, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scripts, similarity
from ..functions import textnorm as tn
from ..operators import alternatives, blocking, components, context, decide, features, metrics, models, quality, retrieve, sampling, vectors
from ..sources import fixtures, tsv
from ..sources.scratch import saved
from . import duck, linkage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
THRESHOLD = 0.5


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def r(*columns: str) -> list:
    """Columns rounded to four places: sums differ in the last bits with the order of rows."""
    return [F.round(c, 4).alias(c) for c in columns]


def rs(*columns: str) -> str:
    return ", ".join(f"round({c}, 4) AS {c}" for c in columns)


raw = fixtures.raw_records


def stored(spark: SparkSession, d: str) -> DataFrame:
    """The corpus as a table: over the union of its three sources, Spark would plan and compile a normalization three times."""
    return saved(raw(spark, d), "raw")


def norm(spark: SparkSession, d: str) -> DataFrame:
    return tn.normalize_records(stored(spark, d))


UNROUNDED = "entity_id, country, src, is_native, is_domain, name_full, name_alt, name_core, legal, name_nospace, state, addr_nums, addr, addr_null"


def sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    s1, targets = linkage.with_blocks(saved(norm(spark, d), "records"))
    return s1, saved(targets, "targets")


def scored(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs with the fixed score, truth, S1 ids)"""
    s1, targets = sides(spark, d)
    p = models.fixed_score(linkage.candidates(s1, targets)).select("s1", "t", "p")
    return p, fixtures.truth(raw(spark, d)), s1.select(F.col("entity_id").alias("s1"))


# Sources and sinks


@query("SELECT p_partkey, p_name, p_brand FROM part WHERE p_size > 25")
def scan_project(spark, d):
    return spark.read.parquet(f"{d}/part.parquet").where("p_size > 25").select("p_partkey", "p_name", "p_brand")


@query(f"WITH {duck.RAW} SELECT entity_id, business_name, business_address, country FROM raw WHERE entity_id LIKE 'S2-%' OR entity_id LIKE 'S3-%'")
def union_targets(spark, d):
    rows = raw(spark, d).drop("k")
    return tsv.union_targets(rows.where("entity_id LIKE 'S2-%'"), rows.where("entity_id LIKE 'S3-%'"))


TRUTH_LISTS = "SELECT 'S1-' || lpad(cast({id} AS string), 8, '0') AS source1_entity_id, CASE WHEN {id} % 5 = 0 THEN NULL WHEN {id} % 5 = 1 THEN '' ELSE 'S2-' || cast({id} AS string) || ',,S3-' || cast({id} AS string) END AS matched_entity_ids FROM {t}"


@query(f"WITH l AS ({TRUTH_LISTS.format(id='p_partkey', t='part')}) SELECT s1, t FROM (SELECT source1_entity_id AS s1, unnest(string_split(coalesce(matched_entity_ids, ''), ',')) AS t FROM l) WHERE t <> ''")
def truth_explode(spark, d):
    return tsv.explode_truth(spark.sql(TRUTH_LISTS.format(id="p_partkey", t="{t}"), t=spark.read.parquet(f"{d}/part.parquet")))


@query(f"WITH {duck.SCORED} SELECT e.entity_id AS source1_entity_id, coalesce(l.ids, '') AS matched_entity_ids FROM s1 e LEFT JOIN (SELECT s1, string_agg(t, ',' ORDER BY t) AS ids FROM assigned WHERE p >= {THRESHOLD} GROUP BY s1) l ON l.s1 = e.entity_id")
def write_lists(spark, d):
    p, _, ids = scored(spark, d)
    return tsv.id_lists(ids, decide.predict_pairs(p, THRESHOLD), "matched_entity_ids")


@query(f"""WITH {duck.SCORED}, good AS (SELECT s1, t FROM assigned WHERE p >= {THRESHOLD})
  SELECT * FROM (VALUES ('missing_s1', 0), ('repeated_s1', 0), ('unknown_s1', 0), ('repeated_match', 0), ('repeated_candidate', 0), ('unknown_match', 0), ('unknown_candidate', 0)) AS v(rule, violations)
  UNION ALL SELECT 'match_not_candidate', count(*) FROM good WHERE t LIKE 'S3-%'""")
def validate_output(spark, d):
    # Candidates of one source only, so that one rule is broken.
    p, _, ids = scored(spark, d)
    chosen = decide.predict_pairs(p, THRESHOLD)
    targets = raw(spark, d).select(F.col("entity_id").alias("t"))
    return quality.validate_output(tsv.id_lists(ids, chosen, "matched_entity_ids"), tsv.id_lists(ids, p.where("t LIKE 'S2-%'"), "candidate_entity_ids"), ids, targets)


# Buckets and samples


@query(f"WITH {duck.RAW} SELECT entity_id, cast(cast(substr(entity_id, 4) AS bigint) % 97 AS int) AS bucket FROM raw")
def id_bucket(spark, d):
    return raw(spark, d).select("entity_id", sampling.id_bucket(F.col("entity_id"), 97).alias("bucket"))


@query(f"WITH {duck.RAW} SELECT entity_id, cast(cast(substr(entity_id, 4) AS bigint) % 5 AS int) AS fold FROM raw WHERE entity_id LIKE 'S1-%'")
def folds(spark, d):
    return sampling.with_folds(raw(spark, d).where("entity_id LIKE 'S1-%'")).select("entity_id", "fold")


@query(f"""WITH {duck.RAW}, s AS (SELECT * FROM raw WHERE entity_id LIKE 'S1-%' AND cast(substr(entity_id, 4) AS bigint) % 10000 < 500),
  linked AS (SELECT entity_id FROM raw WHERE entity_id NOT LIKE 'S1-%' AND k IN (SELECT k FROM s)),
  other AS (SELECT entity_id FROM raw WHERE entity_id NOT LIKE 'S1-%' AND k NOT IN (SELECT k FROM raw WHERE entity_id LIKE 'S1-%') AND cast(substr(entity_id, 4) AS bigint) % 10000 < 500)
  SELECT entity_id FROM s UNION ALL SELECT entity_id FROM linked UNION ALL SELECT entity_id FROM other""")
def sample_world(spark, d):
    rows = raw(spark, d)
    s1, targets = sampling.sample_world(rows.where("entity_id LIKE 'S1-%'"), rows.where("entity_id NOT LIKE 'S1-%'"), fixtures.truth(rows), 0.05)
    return s1.select("entity_id").unionByName(targets.select("entity_id"))


SUBSET = "SELECT entity_id, role FROM (SELECT * FROM s WHERE role = '{role}' ORDER BY md5(entity_id || ':7'), entity_id LIMIT 100)"


@query(f"""WITH {duck.RAW}, f AS (SELECT entity_id, cast(substr(entity_id, 4) AS bigint) % 5 AS fold FROM raw WHERE entity_id LIKE 'S1-%'),
  s AS (SELECT entity_id, CASE fold WHEN 0 THEN 'val' WHEN 4 THEN 'tune' ELSE 'train' END AS role FROM f)
  {' UNION ALL '.join(SUBSET.format(role=r) for r in ('val', 'tune', 'train'))}""")
def entity_subsets(spark, d):
    return sampling.entity_subsets(raw(spark, d).where("entity_id LIKE 'S1-%'"), 100)


# Scalar normalization


def scalar(name: str, spark_column: Callable, sql: str, source: str = "business_name", where: str = "true") -> None:
    def run(spark, d):
        return raw(spark, d).where(where).select("entity_id", spark_column(F.col(source)).alias("out"))

    QUERIES[name] = run
    SQL[name] = f"WITH {duck.RAW} SELECT entity_id, {sql} AS out FROM raw WHERE {where}"


def _low(c):
    return tn.lower_plain(c)


LOW = duck.lowered("business_name")
scalar("strip_accents", _low, duck.lowered("business_address"), "business_address")
scalar("name_junk", lambda c: tn.drop_junk(_low(c)), duck.junk(LOW))
scalar("alias_split", lambda c: F.concat_ws("|", tn.alias_other(_low(c)), tn.alias_main(_low(c))), f"concat_ws('|', {duck.other_part(LOW)}, {duck.main_part(LOW)})")
scalar("domain_names", lambda c: tn.domain_label(_low(c)), duck.label(LOW))
scalar("leet", lambda c: tn.unleet(_low(c)), duck.leet(LOW))
scalar("honorifics", lambda c: tn.drop_honorifics(_low(c)), duck.honorifics(LOW))
scalar("replace_tokens", lambda c: tn.replace_tokens(_low(c), {"saint": "st", "st": "x", "no": "", "inc.": "inc"}), duck.replaced(LOW, {"saint": "st", "st": "x", "no": "", "inc.": "inc"}))
scalar("legal_forms", lambda c: tn.legal_codes(tn.clean_name(_low(c))), duck.legal(duck.cleaned(LOW)))
scalar("name_core", lambda c: tn.core_name(tn.clean_name(_low(c))), duck.cored(duck.cleaned(LOW)))
scalar("addr_clean", tn.clean_address, duck.address("business_address"), "business_address")
scalar("state_detect", lambda c: F.concat_ws("|", tn.state_codes(tn.clean_address(c), F.col("country")), tn.without_states(tn.clean_address(c), F.col("country"))), f"concat_ws('|', {duck.states(duck.address('business_address'))}, {duck.stateless(duck.address('business_address'))})", "business_address")
scalar("street_types", lambda c: tn.canonical_streets(tn.split_numbers(F.replace(tn.clean_address(c), F.lit(","), F.lit(" "))), F.col("country")), duck.streets(duck.numbers_apart(f"replace({duck.address('business_address')}, ',', ' ')")), "business_address")
scalar("addr_nums", lambda c: F.concat_ws("|", tn.address_numbers(tn.split_numbers(tn.clean_address(c))), tn.address_words(tn.split_numbers(tn.clean_address(c)))), f"concat_ws('|', {duck.number_list(duck.numbers_apart(duck.address('business_address')))}, {duck.word_list(duck.numbers_apart(duck.address('business_address')))})", "business_address")


@query(f"WITH {duck.NORM} SELECT {UNROUNDED} FROM records")
def normalize_records(spark, d):
    return norm(spark, d).withColumn("src", F.col("src").cast("int")).select(*UNROUNDED.split(", "))


# Native scripts


def native_pairs(spark, d):
    return spark.sql(fixtures.native_pairs_sql("{raw}"), raw=raw(spark, d))


NATIVE = f"""{duck.RAW}, pairs AS ({fixtures.native_pairs_sql('raw')}),
  couples AS (SELECT k, regexp_extract_all(latin, '[a-z0-9]+') AS l, list_filter(string_split(native, ' '), lambda t: t <> '') AS n FROM pairs),
  words AS (SELECT unnest(n) AS native, unnest(l) AS latin FROM couples WHERE len(l) = len(n)),
  counted AS (SELECT native, latin, count(*) AS c FROM words WHERE regexp_matches(native, '[^\\x00-\\x7F]') GROUP BY ALL),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY native ORDER BY c DESC, latin) AS r, sum(c) OVER (PARTITION BY native) AS total FROM counted),
  dict AS (SELECT native, latin FROM ranked WHERE r = 1 AND c >= 2 AND c / total >= 0.5)"""


@query(f"WITH {duck.RAW}, p AS ({fixtures.native_pairs_sql('raw')}) SELECT k, regexp_matches(native, '[^\\x00-\\x7F]') AS native_flag, regexp_matches(latin, '[^\\x00-\\x7F]') AS latin_flag FROM p")
def is_native(spark, d):
    return native_pairs(spark, d).select("k", tn.is_native(F.col("native")).alias("native_flag"), tn.is_native(F.col("latin")).alias("latin_flag"))


@query(f"WITH {NATIVE} SELECT native, latin FROM dict")
def fit_dictionary(spark, d):
    return scripts.fit_dictionary(native_pairs(spark, d))


@query(f"""WITH {NATIVE}, w AS (SELECT unnest(list_filter(string_split(native, ' '), lambda t: t <> '')) AS native FROM pairs)
  SELECT count(*) AS words, count(dict.latin) AS known, round(count(dict.latin) / count(*), 4) AS coverage FROM w LEFT JOIN dict USING (native)""")
def dict_coverage(spark, d):
    pairs = native_pairs(spark, d)
    return scripts.coverage(pairs, scripts.fit_dictionary(pairs)).select("words", "known", *r("coverage"))


@query()
def transliterate(spark, d):
    pairs = native_pairs(spark, d)
    return scripts.translate_names(pairs.select(F.col("k").alias("entity_id"), F.col("native").alias("business_name")), scripts.fit_dictionary(pairs)).select("entity_id", "rendered")


# Blocks


@query(f"WITH {duck.PURITY} SELECT entity_id, block FROM s1")
def s1_blocks(spark, d):
    return blocking.s1_blocks(norm(spark, d).where("src = 1")).select("entity_id", "block")


@query(f"WITH {duck.PURITY} SELECT country, token, block, round(p, 4) AS p FROM purity")
def state_purity(spark, d):
    return blocking.state_purity(blocking.s1_blocks(norm(spark, d).where("src = 1"))).select("country", "token", "block", *r("p"))


@query(f"WITH {duck.BLOCKS} SELECT entity_id, state, block FROM targets")
def infer_block(spark, d):
    return sides(spark, d)[1].select("entity_id", "state", "block")


# Vectors and retrieval


@query(f"WITH {duck.NORM} SELECT entity_id, array_to_string({duck.TRIGRAMS}, ' ') AS grams FROM records")
def trigrams(spark, d):
    return norm(spark, d).select("entity_id", F.array_join(vectors.trigrams(F.col("name_nospace")), " ").alias("grams"))


@query(f"WITH {duck.NORM} SELECT entity_id, array_to_string({duck.ADDRESS_FEATURES}, ' ') AS doc FROM records")
def addr_docs(spark, d):
    return norm(spark, d).select("entity_id", F.array_join(vectors.address_features(F.col("addr"), F.col("addr_nums")), " ").alias("doc"))


def corpus(spark, d):
    s1, targets = sides(spark, d)
    return s1.unionByName(targets).where("block <> ''")


@query(f"WITH {duck.WEIGHTS} SELECT country, block, entity_id, f, {rs('w')} FROM name_w")
def tfidf(spark, d):
    return vectors.tfidf(corpus(spark, d), vectors.trigrams(F.col("name_nospace")), ["country", "block"]).select("country", "block", "entity_id", "f", *r("w"))


@query(f"WITH {duck.WEIGHTS} SELECT country, block, count(DISTINCT f) AS kept, count(*) AS entries FROM addr_w GROUP BY ALL")
def df_cap(spark, d):
    w = vectors.tfidf(corpus(spark, d), vectors.address_features(F.col("addr"), F.col("addr_nums")), ["country", "block"])
    return w.groupBy("country", "block").agg(F.countDistinct("f").alias("kept"), F.count(F.lit(1)).alias("entries"))


def _top(channel: str) -> None:
    col = retrieve.CHANNELS[channel]

    def run(spark, d):
        scores = saved(retrieve.channel_scores(*sides(spark, d), saved), "scores")
        forward = retrieve.top_k(scores, col, "s1", retrieve.FORWARD[channel], "fwd")
        back = retrieve.top_k(scores, col, "t", retrieve.REVERSE[channel], "rev")
        return retrieve.merged([forward, back], ["fwd", "rev"]).join(scores.select("s1", "t", *r(col)), ["s1", "t"])

    QUERIES[f"topk_{channel}"] = run
    best = [f"SELECT s1, t, {col}, {{0}} AS fwd, {{1}} AS rev FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY round({col}, 6) DESC, {other}) - 1 AS r FROM scores WHERE {col} > {retrieve.MIN_SCORE}) WHERE r < {k}" for by, other, k in (("s1", "t", retrieve.FORWARD[channel]), ("t", "s1", retrieve.REVERSE[channel]))]
    SQL[f"topk_{channel}"] = f"""WITH {duck.SCORES}
      SELECT s1, t, max(fwd)::INT AS fwd, max(rev)::INT AS rev, round(any_value({col}), 4) AS {col} FROM ({best[0].format('r', -1)} UNION ALL {best[1].format(-1, 'r')}) GROUP BY s1, t"""


for _c in retrieve.CHANNELS:
    _top(_c)


@query(f"WITH {duck.FALLBACK.format(before=duck.BLOCKS)} SELECT s1, t, r::INT AS name_rev, {rs('name_cos')} FROM ({duck.top('lost_s', 'name_cos', 't', 2, 'r')}) JOIN lost_s USING (s1, t)")
def fallback_retrieval(spark, d):
    lost = saved(retrieve.fallback_scores(*sides(spark, d), saved), "fallback")
    return retrieve.top_k(lost, "name_cos", "t", 2, "name_rev").join(lost, ["s1", "t"]).select("s1", "t", "name_rev", *r("name_cos"))


@query(f"WITH {duck.RETRIEVED} SELECT s1, t, {', '.join(retrieve.RANKS)}, {rs('name_cos', 'addr_cos')}, same_block FROM retrieved")
def retrieved_pairs(spark, d):
    return retrieve.retrieve(*sides(spark, d), saved).select("s1", "t", *retrieve.RANKS, *r("name_cos", "addr_cos"), "same_block")


GAPS = ("ret_score", "s1_gap", "t_gap", "t_name_gap", "t_addr_gap")
PLACES = ("s1_n_cands", "t_n_cands", "s1_rank", "t_rank")


@query(f"WITH {duck.CONTEXT} SELECT s1, t, {rs(*GAPS)}, {', '.join(PLACES)} FROM pairs")
def context_features(spark, d):
    return context.context_features(retrieve.retrieve(*sides(spark, d), saved)).select("s1", "t", *r(*GAPS), *PLACES)


# Pair features


def candidate_pairs(spark, d):
    """Retrieved pairs with the fields of both records; S1 records; targets."""
    s1, targets = sides(spark, d)
    pairs = saved(retrieve.retrieve(s1, targets, saved).select("s1", "t"), "pairs")
    return features.with_records(pairs, s1, targets), s1, targets


PAIRED = f"""{duck.RETRIEVED}, paired AS (SELECT r.s1, r.t, a.country AS country, {', '.join(f'a.{c} AS a_{c}, b.{c} AS b_{c}' for c in features.FIELDS)}, b.src AS b_src
  FROM retrieved r JOIN records a ON a.entity_id = r.s1 JOIN records b ON b.entity_id = r.t)"""


def _words(c: str) -> str:
    return f"list_distinct(list_filter(string_split({c}, ' '), lambda t: t <> ''))"


def _jaccard(c: str) -> str:
    a, b = _words(f"a_{c}"), _words(f"b_{c}")
    return f"CASE WHEN a_{c} <> '' AND b_{c} <> '' THEN len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))) ELSE 0.0 END"


SETS = ("num_a_in_b", "num_both", "num_first_eq", "legal_both", "legal_any_b", "state_both", "n_len_a", "n_len_b", "b_alias", "b_src3", "first_tok_eq")
JACCARDS = ("num_jac", "legal_jac", "state_eq")


@query(f"""WITH {PAIRED} SELECT s1, t, round({_jaccard('addr_nums')}, 4) AS num_jac, round({_jaccard('legal')}, 4) AS legal_jac, round({_jaccard('state')}, 4) AS state_eq,
  (a_addr_nums <> '' AND b_addr_nums <> '' AND len(list_intersect({_words('a_addr_nums')}, {_words('b_addr_nums')})) = len({_words('a_addr_nums')}))::INT AS num_a_in_b,
  (a_addr_nums <> '' AND b_addr_nums <> '')::INT AS num_both, (a_addr_nums <> '' AND string_split(a_addr_nums, ' ')[1] = string_split(b_addr_nums, ' ')[1])::INT AS num_first_eq,
  (a_legal <> '' AND b_legal <> '')::INT AS legal_both, (b_legal <> '')::INT AS legal_any_b, (a_state <> '' AND b_state <> '')::INT AS state_both,
  len(string_split(a_name_core, ' '))::INT AS n_len_a, len(string_split(b_name_core, ' '))::INT AS n_len_b, (b_name_alt <> '')::INT AS b_alias, (b_src = 3)::INT AS b_src3,
  (string_split(a_name_core, ' ')[1] = string_split(b_name_core, ' ')[1])::INT AS first_tok_eq FROM paired""")
def set_features(spark, d):
    return features.set_features(candidate_pairs(spark, d)[0]).select("s1", "t", *r(*JACCARDS), *SETS)


IDF = f"""{PAIRED}, idf_n AS (SELECT country, count(*) AS n FROM records GROUP BY country),
  idf_df AS (SELECT country, word, count(*) AS df FROM (SELECT country, entity_id, unnest({_words('name_core')}) AS word FROM records) GROUP BY ALL),
  idf AS (SELECT country, word, ln((1 + n) / (1 + df)) + 1 AS idf FROM idf_df JOIN idf_n USING (country))"""


@query(f"WITH {IDF} SELECT country, word, {rs('idf')} FROM idf")
def name_idf(spark, d):
    rows = norm(spark, d)
    return features.name_idf(rows.where("src = 1"), rows.where("src > 1")).select("country", "word", *r("idf"))


IDF_COLUMNS = ("n_idf_cos", "n_idf_a_in_b", "n_idf_b_in_a")


@query(f"""WITH {IDF}, ws AS (SELECT s1, t, country, 'a' AS side, unnest(string_split(a_name_core, ' ')) AS word FROM paired UNION ALL SELECT s1, t, country, 'b', unnest(string_split(b_name_core, ' ')) FROM paired),
  per AS (SELECT s1, t, word, count(*) FILTER (side = 'a') * any_value(idf) AS wa, count(*) FILTER (side = 'b') * any_value(idf) AS wb FROM ws JOIN idf USING (country, word) GROUP BY ALL),
  sums AS (SELECT s1, t, sum(wa * wb) AS dot, sum(wa * wa) AS aa, sum(wb * wb) AS bb, coalesce(sum(wa * wa) FILTER (wb > 0), 0) AS ca, coalesce(sum(wb * wb) FILTER (wa > 0), 0) AS cb FROM per GROUP BY ALL)
  SELECT s1, t, round(coalesce(dot / nullif(sqrt(aa * bb), 0), 0), 4) AS n_idf_cos, round(coalesce(ca / nullif(aa, 0), 0), 4) AS n_idf_a_in_b, round(coalesce(cb / nullif(bb, 0), 0), 4) AS n_idf_b_in_a
  FROM paired LEFT JOIN sums USING (s1, t)""")
def idf_overlap(spark, d):
    pairs, s1, targets = candidate_pairs(spark, d)
    return features.idf_overlap(pairs, features.name_weights(s1, targets)).select("s1", "t", *r(*IDF_COLUMNS))


@query(f"WITH {PAIRED} SELECT s1, t, round(jaro_winkler_similarity(a_name_nospace, b_name_nospace), 4) AS n_nospace_jw FROM paired WHERE a_name_nospace <> '' AND b_name_nospace <> ''")
def jaro_winkler(spark, d):
    pairs = candidate_pairs(spark, d)[0].where("a_name_nospace <> '' AND b_name_nospace <> ''")
    return pairs.select("s1", "t", F.round(similarity.jaro_winkler_udf("a_name_nospace", "b_name_nospace"), 4).alias("n_nospace_jw"))


@query(f"WITH {PAIRED} SELECT s1, t, round(CASE WHEN greatest(length(a_name_core), length(b_name_core)) = 0 THEN 1.0 ELSE 1 - levenshtein(a_name_core, b_name_core) / greatest(length(a_name_core), length(b_name_core)) END, 4) AS n_lev FROM paired")
def levenshtein_sim(spark, d):
    return candidate_pairs(spark, d)[0].select("s1", "t", F.round(similarity.levenshtein_similarity(F.col("a_name_core"), F.col("b_name_core")), 4).alias("n_lev"))


@query()
def string_features(spark, d):
    return features.string_features(candidate_pairs(spark, d)[0]).select("s1", "t", *r(*similarity.NAMES, "n_lev"))


# Decisions and evaluation


@query(f"WITH {duck.SCORED} SELECT s1, t, round(p, 4) AS p FROM (SELECT *, row_number() OVER (PARTITION BY s1 ORDER BY p DESC, t) AS r FROM p WHERE p >= 0.05) WHERE r <= 3")
def prune_select(spark, d):
    return decide.prune(scored(spark, d)[0], "p", 0.05, 3).select("s1", "t", *r("p"))


@query(f"""WITH {duck.SCORED}, y AS (SELECT p, row_number() OVER (ORDER BY p) - 1 AS r, count(*) OVER () AS n FROM p JOIN truth USING (s1, t))
  SELECT round(coalesce(max(p), 0), 4) AS threshold FROM y WHERE r = floor(0.05 * n + 1e-9)""")
def recall_threshold(spark, d):
    p, truth, _ = scored(spark, d)
    return decide.threshold_for_recall(linkage.labelled(p, truth), "p", 0.95).select(*r("threshold"))


@query(f"WITH {duck.SCORED} SELECT s1, t, round(p, 4) AS p FROM assigned")
def assign(spark, d):
    return decide.assign(scored(spark, d)[0]).select("s1", "t", *r("p"))


@query(f"WITH {duck.SCORED} SELECT s1, t, round(p, 4) AS p FROM assigned WHERE p >= {THRESHOLD}")
def predict_pairs(spark, d):
    return decide.predict_pairs(scored(spark, d)[0], THRESHOLD).select("s1", "t", *r("p"))


@query(f"""WITH {duck.SCORED}, grid AS (SELECT unnest({decide.GRID})::DOUBLE AS threshold),
  per AS (SELECT threshold, s1.entity_id AS s1 FROM grid, s1), nt AS (SELECT s1, count(*) AS n FROM truth GROUP BY s1),
  found AS (SELECT threshold, s1, count(*) AS n_pred, count(truth.t) AS tp FROM assigned LEFT JOIN truth USING (s1, t) JOIN grid ON p >= threshold GROUP BY threshold, s1),
  f AS (SELECT threshold, coalesce(nt.n, 0) AS n_true, coalesce(n_pred, 0) AS n_pred, coalesce(tp, 0) AS tp FROM per LEFT JOIN nt USING (s1) LEFT JOIN found USING (threshold, s1))
  SELECT threshold, round(avg(CASE WHEN n_true = 0 AND n_pred = 0 THEN 1.0 WHEN tp = 0 THEN 0.0 ELSE 1.25::DOUBLE * tp / (0.25::DOUBLE * n_true + n_pred) END), 4) AS f FROM f GROUP BY threshold""")
def tune_threshold(spark, d):
    return decide.tune_threshold(*scored(spark, d)).select("threshold", *r("f"))


def _successes(p: str) -> str:
    """The chances of 0, 1, ... successes among independent trials of a list."""
    return f"list_reduce(list_transform({p}, lambda x: [x]), lambda a, x: list_transform(range(1, len(a) + 2), lambda i: coalesce(a[i], 0) * (1 - x[1]) + CASE WHEN i > 1 THEN a[i - 1] * x[1] ELSE 0 END), [1.0::DOUBLE])"


@query(f"""WITH {duck.SCORED}, top AS (SELECT s1, t, p FROM (SELECT *, row_number() OVER (PARTITION BY s1 ORDER BY p DESC, t) AS r FROM assigned WHERE p >= 0.02) WHERE r <= {decide.MAX_PER_S1}),
  lists AS (SELECT s1, list(p ORDER BY p DESC, t) AS ps, list(t ORDER BY p DESC, t) AS ts FROM top GROUP BY s1),
  ks AS (SELECT s1, ps, unnest(range(0, len(ps) + 1)) AS k FROM lists),
  chances AS (SELECT s1, k, {_successes('ps[1:k]')} AS a, {_successes('ps[k + 1:]')} AS b FROM ks),
  cells AS (SELECT s1, k, a, b, unnest(range(0, len(a))) AS i FROM chances), cells2 AS (SELECT s1, k, a[i + 1] AS x, b, i, unnest(range(0, len(b))) AS j FROM cells),
  expected AS (SELECT s1, k, sum(x * b[j + 1] * CASE WHEN k = 0 AND i + j = 0 THEN 1.0 WHEN i > 0 THEN 1.25::DOUBLE * i / (0.25::DOUBLE * (i + j) + k) ELSE 0.0 END) AS v FROM cells2 GROUP BY ALL),
  chosen AS (SELECT s1, min(k) AS k FROM (SELECT *, max(v) OVER (PARTITION BY s1) AS most FROM expected) WHERE v >= most - 1e-9 GROUP BY s1)
  SELECT s1, unnest(ts[1:k]) AS t, round(unnest(ps[1:k]), 4) AS p FROM lists JOIN chosen USING (s1) WHERE k > 0""")
def expected_f(spark, d):
    return decide.expected_f_select(scored(spark, d)[0]).select("s1", "t", *r("p"))


PRED = f"{duck.SCORED}, pred AS (SELECT s1, t FROM assigned WHERE p >= {THRESHOLD}), {duck.per_entity('pred')}"


@query(f"WITH {PRED} SELECT s1, n_pred, n_true, tp, {rs('f')} FROM ents")
def per_entity_f(spark, d):
    p, truth, ids = scored(spark, d)
    return metrics.per_entity_f(decide.predict_pairs(p, THRESHOLD), truth, ids).select("s1", "n_pred", "n_true", "tp", *r("f"))


@query(f"WITH {PRED} SELECT round(avg(f), 4) AS macro_f FROM ents")
def macro_f(spark, d):
    p, truth, ids = scored(spark, d)
    return metrics.macro_f(decide.predict_pairs(p, THRESHOLD), truth, ids).select(*r("macro_f"))


@query(f"""WITH {duck.SCORED}, hits AS (SELECT s1, t FROM p JOIN truth USING (s1, t)), {duck.per_entity('hits')},
  per AS (SELECT e.entity_id AS s1, count(p.t) AS n FROM s1 e LEFT JOIN p ON p.s1 = e.entity_id GROUP BY ALL),
  ordered AS (SELECT n, row_number() OVER (ORDER BY n) - 1 AS r, count(*) OVER () AS m FROM per)
  SELECT sum(n)::BIGINT AS pairs, round(avg(n), 4) AS mean, round(quantile_cont(n, 0.5), 4) AS p50, (SELECT min(n)::DOUBLE FROM ordered WHERE r = round(0.95 * (m - 1))) AS p95,
    round((SELECT count(*) FROM hits) / (SELECT count(*) FROM truth), 4) AS pair_recall, round(1 - sum(n) / (count(*) * (SELECT count(*) FROM targets)), 4) AS reduction, round((SELECT avg(f) FROM ents), 4) AS oracle_f FROM per""")
def blocking_report(spark, d):
    p, truth, ids = scored(spark, d)
    n = raw(spark, d).where("entity_id NOT LIKE 'S1-%'").count()
    return metrics.blocking_report(p, truth, ids, n).select("pairs", *r("mean", "p50"), "p95", *r("pair_recall", "reduction", "oracle_f"))


@query(f"""WITH {PRED} SELECT country, count(*) AS n, round(avg(f), 4) AS f, round(avg((n_true = 0)::INT), 4) AS single_share, round(avg(f) FILTER (n_true = 0), 4) AS single_f
  FROM ents JOIN s1 ON s1.entity_id = ents.s1 GROUP BY country""")
def report_by_group(spark, d):
    p, truth, _ = scored(spark, d)
    return metrics.report_by_group(decide.predict_pairs(p, THRESHOLD), truth, norm(spark, d).where("src = 1")).select("country", "n", *r("f", "single_share", "single_f"))


# Other ways to find, narrow, join up and calibrate pairs

PLACE = ["country", "block"]


def _grams():
    return vectors.trigrams(F.col("name_nospace"))


def _name_words():
    return F.filter(F.split("name_core", " "), lambda w: w != "")


DOC_WORDS = "list_distinct(list_filter(string_split(name_core, ' '), lambda t: t <> ''))"
NAMED = f"""{duck.BLOCKS}, named AS (SELECT entity_id, country, block, name_core FROM s1 WHERE block <> '' UNION ALL SELECT entity_id, country, block, name_core FROM targets WHERE block <> '')"""


@query(f"""WITH {duck.WEIGHTS}, len AS (SELECT country, block, entity_id, sum(tf) AS len FROM name_w_tf GROUP BY ALL), mean AS (SELECT country, block, avg(len) AS mean FROM len GROUP BY ALL),
  idf AS (SELECT x.country, x.block, f, ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) AS idf FROM name_w_df x JOIN name_w_n y USING (country, block) WHERE df >= 2 AND df <= greatest(floor(0.01 * n), 50)),
  docs25 AS (SELECT country, block, f, entity_id AS t, idf * (tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / mean))) AS w FROM name_w_tf JOIN len USING (country, block, entity_id) JOIN mean USING (country, block) JOIN idf USING (country, block, f) WHERE entity_id NOT LIKE 'S1-%'),
  scores25 AS (SELECT q.entity_id AS s1, t, sum(w) AS bm25 FROM name_w_tf q JOIN docs25 USING (country, block, f) WHERE q.entity_id LIKE 'S1-%' GROUP BY ALL)
  SELECT s1, t, r::INT AS r, round(bm25, 4) AS bm25 FROM (SELECT *, row_number() OVER (PARTITION BY s1 ORDER BY round(bm25, 6) DESC, t) - 1 AS r FROM scores25 WHERE bm25 > 0) WHERE r < 3""")
def bm25_topk(spark, d):
    scores = saved(alternatives.bm25_scores(corpus(spark, d), _grams(), PLACE), "bm25")
    return retrieve.top_k(scores, "bm25", "s1", 3, "r", 0.0).join(scores, ["s1", "t"]).select("s1", "t", F.col("r").cast("int").alias("r"), *r("bm25"))


RAREST = f"""{duck.WEIGHTS}, rare AS (SELECT country, block, entity_id, f, df, row_number() OVER (PARTITION BY country, block, entity_id ORDER BY df, f) AS r
  FROM name_w_tf JOIN name_w_df USING (country, block, f) JOIN name_w_n USING (country, block) WHERE df >= 2 AND df <= greatest(floor(0.01 * n), 50))"""


@query(f"WITH {RAREST} SELECT entity_id, f, df FROM rare WHERE r <= 4")
def rarest_features(spark, d):
    return alternatives.rarest_features(corpus(spark, d), _grams(), PLACE).select("entity_id", "f", "df")


@query(f"""WITH {RAREST}, cut AS (SELECT w.* FROM name_w w JOIN rare USING (country, block, entity_id, f) WHERE r <= 8), {duck.scores('lows', 'cut', 'country, block', 'lowest')},
  best AS (SELECT s1, t FROM (SELECT *, row_number() OVER (PARTITION BY s1 ORDER BY round(lowest, 6) DESC, t) AS r FROM lows WHERE lowest > {retrieve.MIN_SCORE}) WHERE r <= 3), {duck.scores('whole', 'name_w', 'country, block', 'name_cos')}
  SELECT s1, t, round(lowest, 4) AS lowest, round(name_cos, 4) AS name_cos FROM best JOIN lows USING (s1, t) JOIN whole USING (s1, t)""")
def truncated_retrieval(spark, d):
    rows = saved(corpus(spark, d), "corpus")
    weights = saved(vectors.tfidf(rows, _grams(), PLACE), "weights")
    few = saved(alternatives.truncated(weights, alternatives.rarest_features(rows, _grams(), PLACE, 8), PLACE), "few")
    lower = saved(retrieve.pair_scores(few, PLACE, "lowest"), "lower")
    best = retrieve.top_k(lower, "lowest", "s1", 3, "r").join(lower, ["s1", "t"]).drop("r")
    # Only the pairs found are scored in full.
    a, b = (best.select("s1", "t", F.col(x).alias("entity_id")).join(weights, "entity_id").select("s1", "t", "f", F.col("w").alias(x + "_w")) for x in ("s1", "t"))
    full = a.join(b, ["s1", "t", "f"]).groupBy("s1", "t").agg(F.sum(F.col("s1_w") * F.col("t_w")).alias("name_cos"))
    return best.join(full, ["s1", "t"]).select("s1", "t", *r("lowest", "name_cos"))


@query(f"WITH {duck.RETRIEVED} SELECT s1, t FROM retrieved WHERE {' OR '.join(f'({c}_fwd >= 0 AND {c}_rev >= 0)' for c in retrieve.CHANNELS)}")
def mutual_topk(spark, d):
    return alternatives.mutual(retrieve.retrieve(*sides(spark, d), saved), list(retrieve.CHANNELS)).select("s1", "t")


@query(f"""WITH {NAMED.replace('name_core FROM', 'name_core, name_nospace FROM')}, o AS (SELECT entity_id, lag(entity_id, 1) OVER w AS a, lag(entity_id, 2) OVER w AS b, lag(entity_id, 3) OVER w AS c FROM named WINDOW w AS (PARTITION BY country, block ORDER BY name_nospace, entity_id)),
  n AS (SELECT entity_id, unnest([a, b, c]) AS other FROM o)
  SELECT DISTINCT least(entity_id, other) AS s1, greatest(entity_id, other) AS t FROM n WHERE other IS NOT NULL AND least(entity_id, other) LIKE 'S1-%' AND greatest(entity_id, other) NOT LIKE 'S1-%'""")
def sorted_neighbourhood(spark, d):
    return alternatives.sorted_neighbourhood(corpus(spark, d), F.col("name_nospace"), PLACE)


@query(f"""WITH {NAMED}, toks AS (SELECT country, block, entity_id, unnest({DOC_WORDS}) AS token FROM named),
  sizes AS (SELECT country, block, token, count(*) AS size FROM toks GROUP BY ALL HAVING count(*) BETWEEN 2 AND 200),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY country, block, entity_id ORDER BY size, token) AS r, count(*) OVER (PARTITION BY country, block, entity_id) AS n FROM toks JOIN sizes USING (country, block, token))
  SELECT entity_id, token FROM ranked WHERE r <= ceil(n * 0.8::DOUBLE - 1e-9)""")
def token_blocks(spark, d):
    return alternatives.token_blocks(corpus(spark, d), _name_words(), PLACE).select("entity_id", "token")


@query(f"""WITH {NAMED}, sets AS (SELECT entity_id, country, block, list_sort({DOC_WORDS}) AS words FROM named WHERE len({DOC_WORDS}) > 0),
  classes AS (SELECT country, block, words, min(entity_id) AS class_id, bool_or(entity_id LIKE 'S1-%') AS has_s1, bool_or(entity_id NOT LIKE 'S1-%') AS has_t FROM sets GROUP BY ALL)
  SELECT class_id, entity_id, NULL::VARCHAR AS linked_id, NULL::DOUBLE AS jaccard FROM sets JOIN classes USING (country, block, words)
  UNION ALL SELECT a.class_id, NULL, b.class_id, round(len(list_intersect(a.words, b.words)) / len(list_distinct(list_concat(a.words, b.words))), 4) FROM classes a JOIN classes b USING (country, block)
  WHERE a.has_s1 AND b.has_t AND 2 * len(list_intersect(a.words, b.words)) >= len(list_distinct(list_concat(a.words, b.words)))""")
def prefix_join(spark, d):
    """Members of the classes of equal token sets (class_id, entity_id), and the links between classes (class_id, linked_id, jaccard)."""
    rows = saved(corpus(spark, d).select("entity_id", *PLACE, "name_core"), "corpus")
    members, links = alternatives.prefix_join(rows, _name_words(), PLACE, save=saved)
    return members.unionByName(links.select("class_id", "linked_id", *r("jaccard")), allowMissingColumns=True).select("class_id", "entity_id", "linked_id", "jaccard")


@query(f"WITH {duck.NORM} SELECT entity_id, regexp_replace(name_core, '[aeiou]', '', 'g') AS skeleton FROM records")
def skeleton_keys(spark, d):
    return norm(spark, d).select("entity_id", alternatives.skeleton(F.col("name_core")).alias("skeleton"))


@query(f"""WITH {duck.CONTEXT}, x AS (SELECT s1, t, ret_score, cast(substr(t, 2, 1) AS int) AS src FROM pairs)
  SELECT s1, t, src, count(*) OVER (PARTITION BY s1, src) AS src_n_cands, row_number() OVER (PARTITION BY s1, src ORDER BY round(ret_score, 6) DESC, t) - 1 AS src_rank, round(max(ret_score) OVER (PARTITION BY s1, src) - ret_score, 4) AS src_gap FROM x""")
def source_features(spark, d):
    return alternatives.source_features(linkage.candidates(*sides(spark, d))).select("s1", "t", "src", "src_n_cands", "src_rank", *r("src_gap"))


@query(f"""WITH {duck.SCORED}, x AS (SELECT *, row_number() OVER (PARTITION BY s1 ORDER BY p DESC, t) AS a, row_number() OVER (PARTITION BY t ORDER BY p DESC, s1) AS b FROM p) SELECT s1, t, round(p, 4) AS p FROM x WHERE a = 1 AND b = 1""")
def mutual_best(spark, d):
    return alternatives.mutual_best(scored(spark, d)[0]).select("s1", "t", *r("p"))


@query(f"""WITH RECURSIVE {duck.SCORED}, e AS MATERIALIZED (SELECT s1 AS u, t AS v FROM p WHERE p >= {THRESHOLD} UNION SELECT t, s1 FROM p WHERE p >= {THRESHOLD}),
  reach AS (SELECT u AS node, u AS root FROM e UNION SELECT e.v, reach.root FROM reach JOIN e ON e.u = reach.node) SELECT node, min(root) AS root FROM reach GROUP BY node""")
def entity_clusters(spark, d):
    pairs = scored(spark, d)[0].where(F.col("p") >= THRESHOLD)
    return components.components(pairs.select(F.col("s1").alias("u"), F.col("t").alias("v")))


@query()
def isotonic_calibration(spark, d):
    p, truth, _ = scored(spark, d)
    pairs = saved(linkage.labelled(p, truth).join(norm(spark, d).where("src = 1").selectExpr("entity_id AS s1", "country"), "s1"), "labelled")
    return alternatives.calibrated(pairs, "country").select("s1", "t", "country", "y", *r("p", "calibrated"))


@query(SQL["tune_threshold"].replace("SELECT threshold, round(avg(", "SELECT round(max(f) / 1.25::DOUBLE, 4) AS threshold FROM (SELECT threshold, avg(").replace(", 4) AS f FROM f GROUP BY threshold", " AS f FROM f GROUP BY threshold)"))
def closed_form_threshold(spark, d):
    best = decide.tune_threshold(*scored(spark, d)).agg(F.max("f").alias("f"))
    return best.select(alternatives.closed_form_threshold(F.col("f")).alias("threshold")).select(*r("threshold"))


# Learned


#: The queries' rounds; linkage.Settings has the full ones, which take minutes on any table.
FEWER = linkage.Settings(pruner_rounds=40, matcher_rounds=60, patience=20)


@query()
def trained_pruner(spark, d):
    s1, targets = sides(spark, d)
    pairs = saved(linkage.labelled(linkage.candidates(s1, targets), fixtures.truth(raw(spark, d))), "labelled")
    return models.score(pairs, models.train_pruner(pairs, features.CONTEXT, rounds=FEWER.pruner_rounds), features.CONTEXT, "p_prune").select("s1", "t", "y", *r("p_prune"))


@query()
def trained_matcher(spark, d):
    s1, targets = sides(spark, d)
    pairs = linkage.labelled(linkage.candidates(s1, targets), fixtures.truth(raw(spark, d)))
    full = saved(features.featurize(pairs, s1, targets).withColumn("is_tune", sampling.id_bucket(F.col("s1"), 5) == 4), "featured")
    names = [*features.CONTEXT, *features.PAIR]
    return models.score(full, models.train_matcher(full, names, rounds=FEWER.matcher_rounds, patience=FEWER.patience), names, "p").select("s1", "t", "y", *r("p"))


@query()
def trained_linkage(spark, d):
    rows = stored(spark, d)
    return linkage.trained_matches(rows.drop("k"), fixtures.truth(rows), FEWER)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return linkage.fixed_matches(stored(spark, d), THRESHOLD).select("s1", "t", *r("p"))


@query(f"WITH {duck.SCORED} SELECT s1, t, round(p, 4) AS p FROM assigned WHERE p >= {THRESHOLD}")
def linkage_matches(spark, d):
    return flagship(spark, d)




def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
