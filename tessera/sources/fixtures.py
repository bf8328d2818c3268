"""A linkage corpus made from the `part` table, in SQL that Spark and DuckDB both read.

S1 is a clean record of every third part. S2 and S3 are noisy copies of all parts: those of other
parts are distractors. A copy belongs to the S1 record with the same key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SYLLABLES = "bakomirutelosanedifu"


def _noise(source: int) -> str:
    kind = f"(k + {0 if source == 2 else 3}) % 8"
    return f"""
    SELECT 'S{source}-' || lpad(cast(k AS string), 8, '0') AS entity_id,
      CASE {kind}
        WHEN 1 THEN upper(replace(stem, ' ', '  ')) || ' ' || upper(legal)
        WHEN 2 THEN 'Shri ' || replace(replace(stem, 'o', '0'), 'e', '3') || ' ' || legal
        WHEN 3 THEN stem
        WHEN 4 THEN stem || ' ' || legal || CASE WHEN k % 2 = 0 THEN ' - 5521374295' ELSE ' (ID: 81649)' END
        WHEN 5 THEN 'Noviorbi DBA ' || stem || ' ' || legal
        WHEN 6 THEN '-- ' || replace(stem, ' ', '') || '.com'
        ELSE stem || ' ' || legal END AS business_name,
      CASE WHEN {kind} = 7 AND k % 3 = 0 THEN NULL
        WHEN {kind} = 7 THEN number || ' ' || street || ', ' || city
        ELSE upper(city) || ', ' || {"short_state" if source == 3 else "state"} || ', No. ' || number || ' ' || street END AS business_address,
      country, k FROM keyed"""


#: {part} stands for the table.
RAW = f"""
  WITH typed AS (
    SELECT p_partkey AS k, p_name, p_size,
      CASE WHEN p_type IN ('ECONOMY', 'SMALL') THEN 'US' WHEN p_type IN ('STANDARD', 'LARGE') THEN 'India' WHEN p_type = 'PROMO' THEN 'France' ELSE 'Germany' END AS country,
      cast(replace(p_brand, 'Brand#', '') AS int) % 3 AS s
    FROM {{part}}),
  keyed AS (
    SELECT k, country,
      p_name || ' ' || substr('{SYLLABLES}', cast(2 * (k % 10) + 1 AS int), 2)
        || substr('{SYLLABLES}', cast(2 * (cast(floor(k / 10) AS bigint) % 10) + 1 AS int), 2)
        || substr('{SYLLABLES}', cast(2 * (cast(floor(k / 100) AS bigint) % 10) + 1 AS int), 2) AS stem,
      CASE k % 4 WHEN 0 THEN 'L.L.C.' WHEN 1 THEN 'Private Limited' WHEN 2 THEN 'SARL' ELSE 'Inc.' END AS legal,
      cast(p_size + (k % 90) AS string) AS number,
      CASE k % 5 WHEN 0 THEN 'Main Street' WHEN 1 THEN 'Station Road' WHEN 2 THEN 'R. Victor Hugo' WHEN 3 THEN 'Park Avenue' ELSE 'Lake Drive' END AS street,
      CASE country WHEN 'US' THEN CASE s WHEN 0 THEN 'Raleigh' WHEN 1 THEN 'Madison' ELSE 'Austin' END
        WHEN 'India' THEN CASE s WHEN 0 THEN 'Pune' WHEN 1 THEN 'Bangalore' ELSE 'Hyderabad' END
        WHEN 'France' THEN CASE s WHEN 0 THEN 'Mérignac' WHEN 1 THEN 'Lille' ELSE 'Le Mans' END ELSE 'Berlin' END AS city,
      CASE country WHEN 'US' THEN CASE s WHEN 0 THEN 'North Carolina' WHEN 1 THEN 'Wisconsin' ELSE 'Texas' END
        WHEN 'India' THEN CASE s WHEN 0 THEN 'Maharashtra' WHEN 1 THEN 'Karnataka' ELSE 'Andhra Pradesh' END
        WHEN 'France' THEN CASE s WHEN 0 THEN 'Nouvelle-Aquitaine' WHEN 1 THEN 'Hauts-de-France' ELSE 'Pays de la Loire' END ELSE 'Brandenburg' END AS state,
      CASE country WHEN 'US' THEN CASE s WHEN 0 THEN 'NC' WHEN 1 THEN 'WI' ELSE 'TX' END
        WHEN 'India' THEN CASE s WHEN 0 THEN 'MH' WHEN 1 THEN 'KA' ELSE 'Telangana' END
        WHEN 'France' THEN CASE s WHEN 0 THEN 'Gironde' WHEN 1 THEN 'Nord' ELSE 'Sarthe' END ELSE 'BB' END AS short_state
    FROM typed)
  SELECT 'S1-' || lpad(cast(k AS string), 8, '0') AS entity_id, stem || ' ' || legal AS business_name,
    number || ' ' || street || ', ' || city || ', ' || state AS business_address, country, k
  FROM keyed WHERE k % 3 = 0
  UNION ALL {_noise(2)}
  UNION ALL {_noise(3)}
"""


def raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity_id, business_name, business_address, country and the key k of all three sources."""
    return spark.sql(RAW, part=dealt(spark.read.parquet(f"{sf_dir}/part.parquet"), "p_partkey"))


def dealt(df: DataFrame, key: str) -> DataFrame:
    """A table of fewer splits than there are cores is dealt out by key, since all that follows is work by row; others stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


def truth(raw: DataFrame) -> DataFrame:
    """(s1, t) of every true pair: ids of an S1 record and a copy of the same part."""
    s1 = raw.where("entity_id LIKE 'S1-%'").selectExpr("k", "entity_id AS s1")
    copies = raw.where("entity_id NOT LIKE 'S1-%'").selectExpr("k", "entity_id AS t")
    return s1.join(copies, "k").select("s1", "t")


#: Renderings of words in a native script, the same in both dialects.
NATIVE_SIGNS = "कखगघचछजझटठडढतथदधनपफबभमयरल"


def native_pairs_sql(raw: str) -> str:
    """(latin, native) names of true India pairs: letters of the native name are signs, word by word; some are garbled."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    stem = "lower(regexp_extract(s.business_name, '^[A-Za-z ]+', 0))"
    return f"""
      SELECT trim({stem}) AS latin,
        translate(trim(CASE WHEN s.k % 7 = 0 THEN replace({stem}, 'a', 'o') ELSE {stem} END), '{letters}', '{NATIVE_SIGNS}') AS native, s.k AS k
      FROM {raw} s WHERE s.entity_id LIKE 'S1-%' AND s.country = 'India'"""
