"""The same computations in DuckDB's SQL, to check the DataFrame operators against."""

from __future__ import annotations

from ..functions import lexicon as lx
from ..functions import textnorm as tn
from ..operators import blocking, retrieve
from ..sources import fixtures

LEAST_DF = 2


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def rr(x: str, pattern: str, to: str) -> str:
    """Replace all matches. Patterns without the Unicode flag, replacements with backslashes."""
    return f"regexp_replace({x}, {q(pattern.replace('(?U)', ''))}, {q(to.replace('$', chr(92)))}, 'g')"


def mapped(table: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"{q(k)}: {q(v)}" for k, v in table.items()) + "}"


def one_of(words) -> str:
    return "(" + ", ".join(q(w) for w in sorted({*words})) + ")"


def replaced(x: str, table: dict[str, str]) -> str:
    return f"array_to_string(list_filter(list_transform(string_split({x}, ' '), lambda t: coalesce({mapped(table)}[t], t)), lambda t: t <> ''), ' ')"


def lowered(x: str) -> str:
    return f"strip_accents(lower(replace(coalesce({x}, ''), 'Â', '')))"


def junk(x: str) -> str:
    for p in (r"\(?\bid\s*:?\s*\d+\)?", r"\s-\s*\d{7,}", r"\d{7,}", r"#\d+"):
        x = rr(x, p, " ")
    return x


def main_part(x: str) -> str:
    p = q(tn.ALIAS.replace("(?U)", ""))
    return f"CASE WHEN regexp_extract({x}, {p}, 2) = '' THEN {x} ELSE regexp_extract({x}, {p}, 2) END"


def other_part(x: str) -> str:
    return f"regexp_extract({x}, {q(tn.ALIAS.replace('(?U)', ''))}, 1)"


def label(x: str) -> str:
    return f"regexp_extract({x}, {q(tn.DOMAIN)}, 1)"


def leet(x: str) -> str:
    for d, letter in lx.LEET:
        x = rr(rr(x, f"([a-z]){d}", rf"\1{letter}"), f"{d}([a-z])", rf"{letter}\1")
    return x


def honorifics(x: str) -> str:
    return rr(rr(x, r"\b(m s)\b", ""), tn.LEADING_HONORIFICS, "")


def letters(x: str) -> str:
    x = rr(x, r"\b(\d+)(st|nd|rd|th)\b", r"\1")
    x = rr(f"replace(replace({x}, '.', ''), '&', ' and ')", "[@$]", "a")
    return f"trim({rr(leet(x), '[^a-z0-9]+', ' ')})"


def cleaned(x: str) -> str:
    return replaced(honorifics(letters(x)), lx.LEGAL_FORMS)


def cored(x: str) -> str:
    return f"array_to_string(list_filter(string_split({x}, ' '), lambda t: t <> '' AND t NOT IN {one_of([*lx.LEGAL_FORMS.values(), *lx.COUNTRY_WORDS])}), ' ')"


def legal(x: str) -> str:
    return f"array_to_string(list_sort(list_distinct(list_filter(string_split({x}, ' '), lambda t: t IN {one_of(lx.LEGAL_FORMS.values())}))), ' ')"


def address(x: str) -> str:
    x = rr(rr(lowered(x), "[^a-z0-9_,]+", " "), r"\s*,\s*", ",")
    return rr(rr(x, r"\b(?:null|none|nil)\b", " "), r"\bn a\b", " ")


def by_country(per: dict[str, str], other: str) -> str:
    return "CASE lower(country) " + " ".join(f"WHEN {q(k)} THEN {v}" for k, v in per.items()) + f" ELSE {other} END"


def states(x: str) -> str:
    return by_country({k: f"array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split({x}, ','), lambda p: {mapped(t)}[trim(p)]), lambda c: c IS NOT NULL))), ' ')" for k, t in lx.state_tables().items()}, "''")


def stateless(x: str) -> str:
    return by_country({k: f"array_to_string(list_filter(string_split({x}, ','), lambda p: {mapped(t)}[trim(p)] IS NULL), ' ')" for k, t in lx.state_tables().items()}, f"replace({x}, ',', ' ')")


def numbers_apart(x: str) -> str:
    x = rr(rr(rr(x, r"\b(\d+)(?:st|nd|rd|th|er|eme|e)\b", r"\1"), r"(\d)([a-z])", r"\1 \2"), r"([a-z])(\d)", r"\1 \2")
    return f"trim({rr(f'replace({x}, {q(chr(95))}, {q(chr(32))})', chr(92) + 's+', ' ')})"


def streets(x: str) -> str:
    tables = lx.street_tables()
    return by_country({k: replaced(x, t) for k, t in tables.items() if k}, replaced(x, tables[""]))


def number_list(x: str) -> str:
    return rf"array_to_string(list_transform(regexp_extract_all({x}, '\b\d+\b'), lambda n: CASE WHEN ltrim(n, '0') = '' THEN '0' ELSE ltrim(n, '0') END), ' ')"


def word_list(x: str) -> str:
    return f"trim({rr(rr(x, chr(92) + 'b' + chr(92) + 'd+' + chr(92) + 'b', ' '), chr(92) + 's+', ' ')})"


RAW = "raw AS (" + fixtures.RAW.format(part="part") + ")"
NORM = f"""{RAW},
  n0 AS (SELECT *, {junk(lowered('business_name'))} AS n, {address('business_address')} AS a FROM raw),
  n1 AS (SELECT *, {main_part('n')} AS main, {other_part('n')} AS alt, {states('a')} AS state, {stateless('a')} AS b FROM n0),
  n2 AS (SELECT *, {label('main')} AS lab, {streets(numbers_apart('b'))} AS c FROM n1),
  n3 AS (SELECT *, lab <> '' AS is_domain, {cleaned("CASE WHEN lab <> '' THEN lab ELSE main END")} AS name_full, {cored(cleaned('alt'))} AS name_alt, {number_list('c')} AS addr_nums, {word_list('c')} AS addr FROM n2),
  norm AS (SELECT entity_id, country, k, cast(substr(entity_id, 2, 1) AS int) AS src, regexp_matches(coalesce(business_name, ''), '[^\\x00-\\x7F\\x{{C0}}-\\x{{24F}}\\x{{2018}}-\\x{{201F}}°º]') AS is_native,
    is_domain, name_full, name_alt, CASE WHEN {cored('name_full')} <> '' THEN {cored('name_full')} ELSE name_full END AS name_core, {legal('name_full')} AS legal, state, addr_nums, addr, addr = '' AND addr_nums = '' AS addr_null FROM n3),
  records AS (SELECT *, replace(name_core, ' ', '') AS name_nospace FROM norm)"""


def first_state(x: str) -> str:
    return f"CASE string_split(coalesce({x}, ''), ' ')[1] WHEN 'tg' THEN 'ap' ELSE string_split(coalesce({x}, ''), ' ')[1] END"


PURITY = f"""{NORM},
  s1 AS (SELECT *, {first_state('state')} AS block FROM records WHERE src = 1),
  seen AS (SELECT country, block, unnest(string_split(addr, ' ')) AS token FROM s1 WHERE block <> ''),
  counted AS (SELECT country, token, block, count(*) AS n FROM seen WHERE length(token) >= {blocking.MIN_TOKEN} GROUP BY ALL),
  totals AS (SELECT *, sum(n) OVER (PARTITION BY country, token) AS total FROM counted),
  purity AS (SELECT country, token, block, n / total AS p FROM totals WHERE total >= {blocking.MIN_SEEN} AND n / total >= {blocking.MIN_SHARE})"""
BLOCKS = f"""{PURITY},
  known AS (SELECT *, {first_state('state')} AS own FROM records WHERE src > 1),
  lost AS (SELECT entity_id, country, unnest(string_split(addr, ' ')) AS token FROM known WHERE own = ''),
  votes AS (SELECT entity_id, block, round(sum(p), 6) AS v FROM lost JOIN purity USING (country, token) GROUP BY ALL),
  won AS (SELECT entity_id, block AS voted FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY v DESC, block) AS r FROM votes) WHERE r = 1),
  targets AS (SELECT known.*, coalesce(voted, own) AS block FROM known LEFT JOIN won USING (entity_id))"""
TRIGRAMS = "list_transform(range(1, greatest(length(name_nospace) - 1, 1)), lambda i: substr(name_nospace, cast(i AS int), 3))"
ADDRESS_FEATURES = r"list_filter(string_split(concat_ws(' ', addr, regexp_replace(addr_nums, '(\d+)', '#\1', 'g')), ' '), lambda t: t <> '')"


def tfidf(name: str, docs: str, features: str, corpus: str, capped: bool = True) -> str:
    """CTEs that end in `name` (corpus, entity_id, f, w)."""
    cap = f"AND df <= greatest(floor(0.01 * n), 50)" if capped else ""
    join = " AND ".join(f"x.{c} = y.{c}" for c in corpus.split(", "))
    return f"""
  {name}_tf AS (SELECT {corpus}, entity_id, f, count(*) AS tf FROM (SELECT {corpus}, entity_id, unnest({features}) AS f FROM {docs}) GROUP BY ALL),
  {name}_n AS (SELECT {corpus}, count(*) AS n FROM {docs} GROUP BY ALL),
  {name}_df AS (SELECT {corpus}, f, count(*) AS df FROM {name}_tf GROUP BY ALL),
  {name}_idf AS (SELECT x.*, ln((1 + n) / (1 + df)) + 1 AS idf FROM {name}_df x JOIN {name}_n y ON {join} WHERE df >= {LEAST_DF} {cap}),
  {name}_v AS (SELECT x.*, (1 + ln(tf)) * idf AS v FROM {name}_tf x JOIN {name}_idf y ON {join} AND x.f = y.f),
  {name} AS MATERIALIZED (SELECT {corpus}, entity_id, f, v / sqrt(sum(v * v) OVER (PARTITION BY {corpus}, entity_id)) AS w FROM {name}_v)"""


def scores(name: str, weights: str, corpus: str, score: str) -> str:
    join = " AND ".join(f"a.{c} = b.{c}" for c in corpus.split(", "))
    return f"""
  {name} AS (SELECT a.entity_id AS s1, b.entity_id AS t, sum(a.w * b.w) AS {score} FROM {weights} a JOIN {weights} b ON {join} AND a.f = b.f
    WHERE a.entity_id LIKE 'S1-%' AND b.entity_id NOT LIKE 'S1-%' GROUP BY ALL)"""


COLUMNS = "entity_id, country, block, name_nospace, addr, addr_nums"
WEIGHTS = f"""{BLOCKS},
  docs AS (SELECT {COLUMNS} FROM s1 WHERE block <> '' UNION ALL SELECT {COLUMNS} FROM targets WHERE block <> ''),
  {tfidf('name_w', 'docs', TRIGRAMS, 'country, block')},
  {tfidf('addr_w', 'docs', ADDRESS_FEATURES, 'country, block')}"""
SCORES = f"""{WEIGHTS},
  {scores('name_s', 'name_w', 'country, block', 'name_cos')},
  {scores('addr_s', 'addr_w', 'country, block', 'addr_cos')},
  scores AS MATERIALIZED (SELECT *, 0.6::DOUBLE * name_cos + (1 - 0.6::DOUBLE) * addr_cos AS blend FROM
    (SELECT s1, t, coalesce(name_cos, 0) AS name_cos, coalesce(addr_cos, 0) AS addr_cos FROM name_s FULL JOIN addr_s USING (s1, t)))"""
FALLBACK = f"""{{before}},
  lost_docs AS (SELECT {COLUMNS} FROM s1 UNION ALL SELECT {COLUMNS} FROM targets WHERE block = ''),
  {tfidf('lost_w', 'lost_docs', TRIGRAMS, 'country')},
  {scores('lost_s', 'lost_w', 'country', 'name_cos')}"""


def top(source: str, score: str, by: str, k: int, rank: str) -> str:
    other = "t" if by == "s1" else "s1"
    return f"SELECT s1, t, r - 1 AS {rank} FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY round({score}, 6) DESC, {other}) AS r FROM {source} WHERE {score} > {retrieve.MIN_SCORE}) WHERE r <= {k}"


def _lists() -> str:
    out = []
    for c, col in retrieve.CHANNELS.items():
        for d, by, ks in (("fwd", "s1", retrieve.FORWARD), ("rev", "t", retrieve.REVERSE)):
            ranks = ", ".join(f"r0 AS {n}" if n == f"{c}_{d}" else f"NULL AS {n}" for n in retrieve.RANKS)
            out.append(f"SELECT s1, t, {ranks} FROM ({top('scores', col, by, ks[c], 'r0')})")
    return " UNION ALL ".join(out)


RETRIEVED = f"""{FALLBACK.format(before=SCORES)},
  listed AS (SELECT s1, t, {', '.join(f'coalesce(max({n}), -1)::INT AS {n}' for n in retrieve.RANKS)} FROM ({_lists()}) GROUP BY ALL),
  retrieved AS MATERIALIZED (SELECT listed.*, name_cos, addr_cos, true AS same_block FROM listed JOIN scores USING (s1, t)
    UNION ALL SELECT s1, t, -1, r::INT, -1, -1, -1, -1, name_cos, NULL, false FROM ({top('lost_s', 'name_cos', 't', 2, 'r')}) JOIN lost_s USING (s1, t))"""
CONTEXT = f"""{RETRIEVED},
  ret AS (SELECT *, 0.6::DOUBLE * coalesce(name_cos, 0) + 0.4::DOUBLE * coalesce(addr_cos, 0) AS ret_score FROM retrieved),
  pairs AS (SELECT *, count(*) OVER (PARTITION BY s1) AS s1_n_cands, max(ret_score) OVER (PARTITION BY s1) - ret_score AS s1_gap,
    row_number() OVER (PARTITION BY s1 ORDER BY round(ret_score, 6) DESC, t) - 1 AS s1_rank,
    count(*) OVER (PARTITION BY t) AS t_n_cands, max(ret_score) OVER (PARTITION BY t) - ret_score AS t_gap,
    row_number() OVER (PARTITION BY t ORDER BY round(ret_score, 6) DESC, s1) - 1 AS t_rank,
    max(name_cos) OVER (PARTITION BY t) - name_cos AS t_name_gap, max(addr_cos) OVER (PARTITION BY t) - addr_cos AS t_addr_gap FROM ret)"""
SCORED = f"""{CONTEXT},
  p AS (SELECT s1, t, round(1 / (1 + exp(-(9 * coalesce(name_cos, 0) + 5 * coalesce(addr_cos, 0) - 0.8::DOUBLE * t_rank - 5))), 6) AS p FROM pairs),
  truth AS (SELECT x.entity_id AS s1, y.entity_id AS t FROM raw x JOIN raw y USING (k) WHERE x.entity_id LIKE 'S1-%' AND y.entity_id NOT LIKE 'S1-%'),
  assigned AS (SELECT s1, t, p FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY p DESC, s1) AS r FROM p) WHERE r = 1)"""


def per_entity(pred: str) -> str:
    """CTE `ents` of every S1 record for the pairs in pred."""
    return f"""
  ents AS (SELECT s1, n_pred, n_true, tp, CASE WHEN n_true = 0 AND n_pred = 0 THEN 1.0 WHEN tp = 0 THEN 0.0 ELSE 1.25::DOUBLE * tp / (0.25::DOUBLE * n_true + n_pred) END AS f FROM
    (SELECT e.entity_id AS s1, coalesce(a.n, 0) AS n_pred, coalesce(b.n, 0) AS n_true, coalesce(c.n, 0) AS tp FROM s1 e
      LEFT JOIN (SELECT s1, count(*) AS n FROM {pred} GROUP BY s1) a ON a.s1 = e.entity_id LEFT JOIN (SELECT s1, count(*) AS n FROM truth GROUP BY s1) b ON b.s1 = e.entity_id
      LEFT JOIN (SELECT s1, count(*) AS n FROM {pred} JOIN truth USING (s1, t) GROUP BY s1) c ON c.s1 = e.entity_id))"""
