"""Inputs of the operators, derived from the given tables.

One text per view, in SQL that Spark and the checking engine both understand, so both sides
start from the same rows. Operators are written with the library on the Spark side and
independently in SQL on the other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()

_SPOT = """
  CASE WHEN k % 11 <> 0 THEN 30e0 + CAST(floor(city_id / 5) AS DOUBLE) * 5e0 + 0.5e0
    + CAST(k % 6 AS DOUBLE) * 0.5e0 + CAST(CAST(floor(k / 30) AS BIGINT) % 5 AS DOUBLE) * 0.0004e0
  END AS lat,
  CASE WHEN k % 11 <> 0 THEN -100e0 + CAST(city_id % 5 AS DOUBLE) * 10e0 + 0.5e0
    + CAST(k % 10 AS DOUBLE) * 0.5e0 + CAST(CAST(floor(k / 30) AS BIGINT) % 3 AS DOUBLE) * 0.0006e0
  END AS lng"""

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "city": (("nation",), """
SELECT CAST(n_nationkey AS BIGINT) AS city_id, lower(replace(n_name, '_', '-')) AS slug,
  'R' || CAST(n_regionkey AS STRING) AS country_code, n_name AS name_en,
  -100e0 + CAST(n_nationkey % 5 AS DOUBLE) * 10e0 AS west,
  30e0 + CAST(floor(n_nationkey / 5) AS DOUBLE) * 5e0 AS south,
  -92e0 + CAST(n_nationkey % 5 AS DOUBLE) * 10e0 AS east,
  34e0 + CAST(floor(n_nationkey / 5) AS DOUBLE) * 5e0 AS north,
  n_nationkey % 7 <> 6 AS enabled, 'S' || CAST(n_nationkey % 4 AS STRING) AS region
FROM {nation}"""),
    "country": (("region",), """
SELECT 'R' || CAST(r_regionkey AS STRING) AS code, r_name AS name_en,
  CASE WHEN r_regionkey IN (2, 4) THEN 0.45e0 END AS min_display_score,
  r_regionkey <> 1 AS enabled
FROM {region}"""),
    "listing": (("customer", "part"), f"""
SELECT source_id, external_id, city_id, name, category, k, {_SPOT}
FROM (SELECT CASE c_custkey % 3 WHEN 0 THEN 'overture' WHEN 1 THEN 'osm' ELSE 'wikidata' END
    AS source_id, 'c' || CAST(c_custkey AS STRING) AS external_id,
    CAST(c_nationkey AS BIGINT) AS city_id,
    p_name || CASE c_custkey % 5 WHEN 0 THEN ' Restaurant' WHEN 1 THEN ' Inc.' WHEN 2 THEN 's'
      ELSE '' END AS name, lower(c_mktsegment) AS category, c_custkey AS k
  FROM {{customer}} JOIN {{part}} ON p_partkey = c_custkey % 200) AS t"""),
    "listing_link": (("customer",), """
SELECT CASE c_custkey % 3 WHEN 0 THEN 'overture' WHEN 1 THEN 'osm' ELSE 'wikidata' END
    AS source_id, 'c' || CAST(c_custkey AS STRING) AS external_id, 'website' AS kind,
  'site' || CAST(c_custkey % 37 AS STRING) || '.example.com' AS value,
  'https://site' || CAST(c_custkey % 37 AS STRING) || '.example.com/' AS url
FROM {customer}
UNION ALL
SELECT CASE c_custkey % 3 WHEN 0 THEN 'overture' WHEN 1 THEN 'osm' ELSE 'wikidata' END,
  'c' || CAST(c_custkey AS STRING), 'instagram', 'shop' || CAST(c_custkey % 23 AS STRING),
  'https://www.instagram.com/shop' || CAST(c_custkey % 23 AS STRING) || '/'
FROM {customer} WHERE c_custkey % 4 = 0"""),
    "entity": (("supplier", "part"), f"""
SELECT business_id, city_id, name_latin, name_fa, {_SPOT}
FROM (SELECT 's' || lpad(CAST(s_suppkey AS STRING), 12, '0') AS business_id,
    CAST(s_nationkey AS BIGINT) AS city_id, p_name AS name_latin,
    CAST(NULL AS STRING) AS name_fa, s_suppkey AS k
  FROM {{supplier}} JOIN {{part}} ON p_partkey = s_suppkey % 200) AS t"""),
    "entity_link": (("supplier",), """
SELECT 's' || lpad(CAST(s_suppkey AS STRING), 12, '0') AS business_id, 'website' AS kind,
  'site' || CAST(s_suppkey % 37 AS STRING) || '.example.com' AS value
FROM {supplier}"""),
    "business": (("orders",), f"""
SELECT k AS business_id, city_id, status, name_latin, name_fa, address, verified, {_SPOT}
FROM (SELECT o_orderkey AS k, CAST(o_custkey % 25 AS BIGINT) AS city_id,
    CASE WHEN o_orderstatus = 'P' AND o_orderkey % 4 = 0 THEN 'hidden'
      WHEN o_orderkey % 9 = 0 THEN 'closed' ELSE 'active' END AS status,
    'Shop ' || lpad(CAST(o_orderkey % 5000 AS STRING), 4, '0') AS name_latin,
    CAST(NULL AS STRING) AS name_fa, o_orderpriority || ' Street' AS address,
    o_orderdate AS verified
  FROM {{orders}}) AS t"""),
    "evidence": (("lineitem",), """
SELECT l_orderkey AS business_id, 'src' || CAST(l_suppkey % 4 AS STRING) AS source_id,
  CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) AS external_id,
  CASE WHEN l_returnflag = 'R' AND l_suppkey % 5 = 0 THEN 'negative_keyword'
    ELSE l_returnflag || l_linestatus END AS signal,
  CAST(round(l_discount * 100) AS DOUBLE) * 9e0 / 100e0 AS weight,
  'part ' || CAST(l_partkey AS STRING) AS snippet, l_partkey AS ord
FROM {lineitem}"""),
    "record": (("lineitem",), """
SELECT 'src' || CAST(min(l_suppkey) % 4 AS STRING) AS source_id,
  CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) AS external_id,
  l_orderkey AS business_id, 'https://r.example/' || CAST(min(l_partkey) AS STRING) AS url,
  min(l_shipdate) AS fetched_at
FROM {lineitem} GROUP BY l_orderkey, l_linenumber"""),
    "link": (("lineitem",), """
SELECT l_orderkey AS business_id, CASE l_linenumber % 5 WHEN 0 THEN 'website'
    WHEN 1 THEN 'facebook' WHEN 2 THEN 'instagram' WHEN 3 THEN 'telegram' ELSE 'phone' END AS kind,
  'v' || CAST(l_partkey % 400 AS STRING) AS value,
  min('https://l.example/' || CAST(l_partkey AS STRING)) AS url, min(l_partkey) AS link_id
FROM {lineitem} GROUP BY 1, 2, 3"""),
    "category": (("part",), """
SELECT lower(p_type) AS slug, CAST(NULL AS STRING) AS parent_slug,
  CAST(length(p_type) AS INT) AS position
FROM {part} GROUP BY p_type
UNION ALL
SELECT lower(p_type) || '/' || lower(replace(p_brand, '#', '')), lower(p_type),
  CAST(substr(p_brand, 7) AS INT)
FROM {part} GROUP BY p_type, p_brand"""),
    "business_category": (("lineitem", "part"), """
SELECT DISTINCT l_orderkey AS business_id, CASE WHEN l_partkey % 2 = 0 THEN lower(p_type)
  ELSE lower(p_type) || '/' || lower(replace(p_brand, '#', '')) END AS slug
FROM {lineitem} JOIN {part} ON p_partkey = l_partkey WHERE l_linenumber % 3 = 0"""),
    "label": (("orders",), """
SELECT o_orderkey AS business_id, o_totalprice < 350000 AS verdict,
  'user' || CAST(o_custkey % 7 AS STRING) AS labeled_by, o_orderdate AS labeled_at
FROM {orders} WHERE o_orderkey % 3 = 0"""),
    "doc": (("documents",), """
SELECT doc_id, text, CASE doc_id % 4 WHEN 0 THEN 'name' WHEN 1 THEN 'text'
    WHEN 2 THEN 'page_head' ELSE 'page' END AS kind,
  'https://' || source || '.example/' || CAST(doc_id AS STRING) AS url,
  CASE lang WHEN 'fr' THEN 'FR' WHEN 'de' THEN 'DE' ELSE 'US' END AS country
FROM {documents}"""),
    "script_doc": (("documents",), """
SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN translate(text, 'aeiou', 'اپیوگ')
  WHEN 1 THEN translate(text, 'aeiou', 'اهیوک') WHEN 2 THEN translate(text, 'aeiou', 'اهيوك')
  WHEN 3 THEN text ELSE translate(text, 'aeiou', 'اٹیوک') END AS text,
  CASE WHEN doc_id % 2 = 0 THEN 'name' ELSE 'text' END AS kind
FROM {documents}"""),
    "report": (("events",), """
SELECT event_id AS report_id, user_id % 97 AS business_id,
  CASE event_type WHEN 'error' THEN 'not_relevant' WHEN 'click' THEN 'closed'
    ELSE 'wrong_info' END AS reason,
  CASE WHEN event_id % 3 = 0 THEN 'resolved' ELSE 'open' END AS status,
  ts AS created_at, value
FROM {events}"""),
    "submission": (("events",), """
SELECT event_id AS submission_id, CAST(user_id % 25 AS BIGINT) AS city_id, user_id,
  'Shop ' || CAST(user_id AS STRING) AS name,
  CASE event_id % 4 WHEN 0 THEN 'approved' WHEN 1 THEN 'rejected' ELSE 'pending' END AS status,
  'https://site' || CAST(user_id % 37 AS STRING) || '.example.com/' AS link,
  ts AS created_at
FROM {events} WHERE event_type = 'signup'"""),
    "city_status": (("orders",), """
SELECT CAST(o_custkey % 25 AS BIGINT) AS city_id, max(o_orderdate) AS last_indexed_at,
  'r' || CAST(max(o_custkey) % 10 AS STRING) AS release
FROM {orders} WHERE o_custkey % 25 <> 7 GROUP BY 1"""),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in TABLES:
        return table(spark, sf_dir, name)
    deps, sql = VIEWS[name]
    return spark.sql(sql, **{d: view(spark, sf_dir, d) for d in deps})


def ctes(*names: str) -> str:
    """WITH list of the named views and everything they need, for the checking engine."""
    done: dict[str, str] = {}

    def add(name: str) -> None:
        if name in TABLES or name in done:
            return
        deps, sql = VIEWS[name]
        for d in deps:
            add(d)
        done[name] = sql.format(**{d: d for d in deps})

    for n in names:
        add(n)
    return ",\n".join(f"{n} AS ({q})" for n, q in done.items())


Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: str = "", extra: str = ""):
    """Register a query. ``sql`` is the check's final SELECT over the CTEs of ``views`` and
    the ``extra`` CTEs."""
    def register(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(lambda n: view(spark, sf_dir, n))

        QUERIES[name] = run
        if sql is not None:
            head = ",\n".join(x for x in (ctes(*views.split()), extra.strip().rstrip(",")) if x)
            ORACLES[name] = (f"WITH RECURSIVE {head}\n" if head else "") + sql.strip()
        return fn

    return register
