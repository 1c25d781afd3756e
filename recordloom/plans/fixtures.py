"""Three record sources and their truth, derived from the customer, part and nation tables.

The SQL runs unchanged in Spark and DuckDB; names and addresses are made noisy on
purpose, in ASCII only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("customer", "part", "nation")

_BASE = """SELECT c.c_custkey AS k, p.p_name AS pn, p.p_type AS pt, n.n_regionkey AS rg, c.c_custkey % 50 AS g
FROM customer c JOIN part p ON p.p_partkey = c.c_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey"""

_S1 = """SELECT 'S1-' || CAST(k AS STRING) AS entity_id,
  upper(pn) || ' ' || CAST(g AS STRING) || CASE k % 4 WHEN 0 THEN ' Pvt Ltd' WHEN 1 THEN ' & Co' WHEN 2 THEN ' LLC' ELSE '' END AS business_name,
  '0' || CAST(k % 97 AS STRING) || ' ' || pt || CASE k % 3 WHEN 0 THEN ' St, Apt ' WHEN 1 THEN ' Rd, Ste ' ELSE ' Ave, Unit ' END || CAST(k % 11 AS STRING)
    || CASE rg % 3 WHEN 0 THEN ', OH' WHEN 1 THEN ', MH' ELSE ', rue de la Gare' END AS business_address,
  CASE rg WHEN 0 THEN 'US' WHEN 1 THEN 'India' WHEN 2 THEN 'France' WHEN 3 THEN 'United States' ELSE 'FR' END AS country
FROM base"""

_S2 = """SELECT 'S2-' || CAST(k AS STRING) AS entity_id,
  CASE k % 6 WHEN 0 THEN 'none' ELSE pn || ', ' || CAST(g AS STRING) || CASE k % 4 WHEN 0 THEN ' (Pvt.) Ltd.' WHEN 1 THEN ' and Co.' WHEN 2 THEN ' Inc' ELSE '' END END AS business_name,
  CASE k % 7 WHEN 0 THEN '' ELSE CAST(k % 97 AS STRING) || ' ' || lower(pt)
    || CASE k % 3 WHEN 0 THEN ' street apartment ' WHEN 1 THEN ' road suite ' ELSE ' avenue unit ' END || CAST(k % 11 AS STRING)
    || CASE rg % 3 WHEN 0 THEN ' ohio' WHEN 1 THEN ' Maharashtra' ELSE ' rue de la gare' END END AS business_address,
  CASE rg WHEN 0 THEN 'USA' WHEN 1 THEN 'Bharat' WHEN 2 THEN 'fr' WHEN 3 THEN 'U.S.' ELSE 'French Republic' END AS country
FROM base WHERE k % 3 <> 0"""

_S3 = """SELECT 'S3-' || CAST(k AS STRING) AS entity_id, pn || ' ' || CAST(g AS STRING) AS business_name,
  '  ' || pt || ' ' || CAST(k % 11 AS STRING) AS business_address,
  CASE rg WHEN 0 THEN 'america' WHEN 1 THEN ' INDIA ' WHEN 2 THEN 'FRANCE' WHEN 3 THEN 'us' ELSE 'fr' END AS country
FROM base WHERE k % 5 IN (1, 2)"""

_TRUTH = """SELECT 'S1-' || CAST(k AS STRING) AS source1_entity_id,
  concat_ws(',', CASE WHEN k % 3 <> 0 THEN 'S2-' || CAST(k AS STRING) END, CASE WHEN k % 5 IN (1, 2) THEN 'S3-' || CAST(k AS STRING) END) AS matched_entity_ids
FROM (SELECT c_custkey AS k FROM customer) t"""

#: Common table expressions, for SQL that goes on from them.
CTES = f"base AS ({_BASE}),\ns1 AS ({_S1}),\ns2 AS ({_S2}),\ns3 AS ({_S3}),\ntruth AS ({_TRUTH})"


_opened: dict[tuple[int, str, str], dict[str, DataFrame]] = {}


def _tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The tables' plans, opened once a session: schemas are read from the files' footers."""
    key = (id(spark), spark.sparkContext.applicationId, sf_dir)
    if key not in _opened:
        _opened.clear()
        _opened[key] = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}
    return _opened[key]


def _named(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One fixture, on plans of its own: no session-wide view is left behind."""
    frames = _tables(spark, sf_dir)
    body = {"s1": _S1, "s2": _S2, "s3": _S3}.get(name)
    query = f"WITH base AS ({_BASE}) {body}" if body else _TRUTH
    for t, df in frames.items():
        query = query.replace(f"FROM {t} ", f"FROM {{{t}}} ").replace(f"JOIN {t} ", f"JOIN {{{t}}} ").replace(f"FROM {t})", f"FROM {{{t}}})")
    used = {t: df for t, df in frames.items() if f"{{{t}}}" in query}
    return spark.sql(query, **used)


def s1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(spark, sf_dir, "s1")


def s2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(spark, sf_dir, "s2")


def s3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(spark, sf_dir, "s3")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s2(spark, sf_dir).unionByName(s3(spark, sf_dir))


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(spark, sf_dir, "truth")


#: Ways in which a result file is damaged, so that every check has something to find:
#: rows are left out, added and repeated, ids repeated, foreign or unknown.
DAMAGE = """SELECT source1_entity_id,
  CASE WHEN k % 13 = 0 THEN matched_entity_ids || ',S2-1,S2-1' WHEN k % 13 = 1 THEN 'S1-7' WHEN k % 13 = 2 THEN 'X-1,S2-999999999' ELSE matched_entity_ids END AS matched_entity_ids
FROM (SELECT source1_entity_id, matched_entity_ids, CAST(substring(source1_entity_id, 4) AS BIGINT) AS k FROM results) t WHERE k % 17 <> 0
UNION ALL SELECT source1_entity_id || 'x', '' FROM results WHERE source1_entity_id = 'S1-3'
UNION ALL SELECT source1_entity_id, matched_entity_ids FROM results WHERE source1_entity_id IN ('S1-4', 'S1-5')"""


def damaged(results: DataFrame) -> DataFrame:
    return results.sparkSession.sql(DAMAGE.replace("FROM results", "FROM {results}"), results=results)
