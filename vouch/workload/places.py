"""Spatial, matching, category, address and city queries over derived listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from vouch import fixed_values as fv
from vouch.functions import address, categories, geo
from vouch.functions import text as tx
from vouch.functions.similarity import token_set_ratio
from vouch.operators import filters as fl
from vouch.operators import matching, near_names, spatial
from vouch.operators import ranking as rk
from vouch.operators import upsert as up
from vouch.operators.lineage import cut
from vouch.plans import cities as city_plan
from vouch.plans import index, schedule
from vouch.plans.resolve import resolve_entities
from vouch.sources import dims
from vouch.workload.views import query

HAVERSINE = ("2 * 6371008.8 * asin(sqrt(least(1.0, pow(sin((radians({b}.lat) - radians({a}.lat)) / 2),"
             " 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lng - "
             "{a}.lng) / 2), 2))))")
AWAY = HAVERSINE.format(a="l", b="e")
CITY_OF = "JOIN city c ON l.lng BETWEEN c.west AND c.east AND l.lat BETWEEN c.south AND c.north"


def norm_sql(col: str) -> str:
    words = ", ".join("'" + w.replace("'", "''") + "'" for w in fv.GENERIC_NAME_WORDS)
    return (rf"array_to_string(list_filter(string_split_regex(trim(regexp_replace(lower({col}), "
            rf"'[^\p{{L}}\p{{N}}_\s&]', ' ', 'g')), '\s+'), lambda w: w <> '' AND w NOT IN ({words})),"
            " ' ')")


def links_of(t):
    pairs = t("listing_link").groupBy("source_id", "external_id").agg(
        F.collect_list(F.struct("kind", "value", "url")).alias("links"))
    return t("listing").join(pairs, ["source_id", "external_id"], "left").withColumn(
        "links", F.coalesce("links", F.array().cast(
            "array<struct<kind:string,value:string,url:string>>")))


@query("pf_1_in_bbox", "SELECT l.external_id FROM listing l JOIN city c USING (city_id) WHERE "
       "l.lat BETWEEN c.south + 1 AND c.north AND l.lng BETWEEN c.west AND c.east - 4",
       "listing city")
def _(t):
    df = t("listing").join(t("city").select("city_id", "west", "south", "east", "north"), "city_id")
    inside = geo.in_box("lat", "lng", F.col("west"), F.col("south") + 1, F.col("east") - 4,
                        F.col("north"))
    return df.where(inside).select("external_id")


@query("pf_8_private_location_mask", "SELECT external_id, CASE WHEN source_id <> 'osm' THEN lat "
       "END AS lat, lat AS match_lat FROM listing", "listing")
def _(t):
    df = t("listing").withColumn("private_location", F.col("source_id") == "osm").withColumn(
        "address", F.lit("x"))
    return fl.mask_private(df).select("external_id", "lat", "match_lat")


@query("jn_1_city_box_join", f"SELECT l.external_id, c.slug FROM listing l {CITY_OF}",
       "listing city")
def _(t):
    pairs = spatial.city_box_join(t("listing").drop("city_id"), t("city"))
    return pairs.select("external_id", "slug")


@query("jn_2_covering_city", """
SELECT l.external_id, arg_min(c.slug, (c.east - c.west) * (c.north - c.south)) AS slug
FROM (SELECT l.*, k.country_code FROM listing l JOIN city k USING (city_id)) l
JOIN (SELECT slug, country_code, west, south, east, north FROM city UNION ALL
  SELECT slug || '-west', country_code, west, south, west + 4, north FROM city) c
  ON c.country_code = l.country_code AND l.lng BETWEEN c.west AND c.east
  AND l.lat BETWEEN c.south AND c.north GROUP BY 1""", "listing city")
def _(t):
    box = t("city").select("slug", "country_code", "west", "south", "east", "north")
    west = box.withColumns({"slug": F.concat("slug", F.lit("-west")), "east": F.col("west") + 4})
    points = t("listing").join(t("city").select("city_id", "country_code"), "city_id")
    return spatial.covering_city(points, box.unionByName(west), "external_id")


@query("jn_3_record_match", """
SELECT l.external_id, l.source_id, 'b' || CAST(l.k AS VARCHAR) AS business_id FROM listing l
WHERE l.k % 2 = 0""", "listing")
def _(t):
    known = t("listing").where(F.col("k") % 2 == 0).select(
        "source_id", "external_id", F.concat(F.lit("b"), F.col("k").cast("string"))
        .alias("business_id"))
    return matching.record_match(t("listing"), known)


@query("jn_4_link_match", f"""
SELECT l.external_id, min(e.business_id) AS business_id FROM listing l
JOIN listing_link x USING (source_id, external_id) JOIN entity_link y USING (kind, value)
JOIN entity e ON e.business_id = y.business_id AND e.city_id = l.city_id
WHERE l.lat IS NULL OR e.lat IS NULL OR {AWAY} <= 1000 GROUP BY 1""",
       "listing listing_link entity entity_link")
def _(t):
    return matching.link_match(links_of(t), t("entity"), t("entity_link")).select(
        "external_id", "business_id")


# similarity of normalised names: words in common, rests, longest common subsequence
SIMILAR = f"""
lnames AS (SELECT *, {norm_sql("name")} AS a FROM listing),
enames AS (SELECT *, {norm_sql("name_latin")} AS b FROM entity),
pairs AS (SELECT DISTINCT a, b FROM lnames l JOIN enames e USING (city_id)),
split AS (SELECT a, b, list_sort(list_distinct(string_split(a, ' '))) AS x,
  list_sort(list_distinct(string_split(b, ' '))) AS y FROM pairs WHERE a <> '' AND b <> ''),
rests AS (SELECT a, b, length(array_to_string(list_filter(x, lambda w: list_contains(y, w)), ' '))
    AS nb, array_to_string(list_filter(x, lambda w: NOT list_contains(y, w)), ' ') AS ra,
  array_to_string(list_filter(y, lambda w: NOT list_contains(x, w)), ' ') AS rb FROM split),
dp AS (SELECT DISTINCT ra, rb, 0 AS i, list_transform(range(0, length(rb) + 1), lambda z: 0::BIGINT)
    AS cells FROM rests
  UNION ALL SELECT ra, rb, i + 1, list_transform(range(0, length(rb) + 1), lambda j:
    CASE WHEN j = 0 THEN 0::BIGINT ELSE list_max(list_transform(range(1, j + 1), lambda q: greatest(
      cells[q + 1], CASE WHEN substr(rb, q, 1) = substr(ra, i + 1, 1) THEN cells[q] + 1
        ELSE 0 END))) END) FROM dp WHERE i < length(ra)),
lcs AS (SELECT ra, rb, cells[length(rb) + 1] AS n FROM dp WHERE i = length(ra)),
sims AS (SELECT a, b, CASE WHEN nb > 0 AND (ra = '' OR rb = '') THEN 100e0 ELSE greatest(
    100e0 - 100e0 * (length(ra) + length(rb) - 2 * n) / (2 * (nb + CASE WHEN nb > 0 THEN 1
      ELSE 0 END) + length(ra) + length(rb)),
    CASE WHEN nb > 0 THEN 100e0 - 100e0 * (1 + length(ra)) / (2 * nb + 1 + length(ra)) ELSE 0 END,
    CASE WHEN nb > 0 THEN 100e0 - 100e0 * (1 + length(rb)) / (2 * nb + 1 + length(rb)) ELSE 0 END
    ) END AS sim FROM rests JOIN lcs USING (ra, rb))"""


@query("fn_8_normalize_name", f"SELECT external_id, {norm_sql('name')} AS name FROM listing",
       "listing")
def _(t):
    return t("listing").select("external_id", tx.normalize_name("name").alias("name"))


@query("fn_9_name_similarity", "SELECT a, b, round(sim, 6) AS similarity FROM sims",
       "listing entity", SIMILAR)
def _(t):
    a = t("listing").select("city_id", tx.normalize_name("name").alias("a")).distinct()
    b = t("entity").select("city_id", tx.normalize_name("name_latin").alias("b")).distinct()
    pairs = a.join(b, "city_id").select("a", "b").distinct().where("a <> '' AND b <> ''")
    return pairs.select("a", "b", F.round(token_set_ratio("a", "b"), 6).alias("similarity"))


NEAREST = f"""
SELECT external_id, business_id, round(sim, 6) AS similarity FROM (SELECT l.external_id,
    e.business_id, s.sim, row_number() OVER (PARTITION BY l.external_id ORDER BY s.sim DESC,
      CASE WHEN l.a = e.b THEN 0 ELSE 1 END, e.business_id) AS r
  FROM lnames l JOIN enames e USING (city_id) JOIN sims s ON s.a = l.a AND s.b = e.b
  WHERE {AWAY} <= 150 AND s.sim >= 80) t WHERE r = 1"""


@query("jn_5_nearby_match", NEAREST, "listing entity", SIMILAR)
def _(t):
    df = matching.nearby_match(t("listing"), t("entity"), settle=cut)
    return df.select("external_id", "business_id", F.round("similarity", 6).alias("similarity"))


@query("wn_7_best_match", f"SELECT external_id, similarity FROM ({NEAREST}) z",
       "listing entity", SIMILAR)
def _(t):
    near = t("listing").select("external_id", "city_id", "lat", "lng",
                               tx.normalize_name("name").alias("name")).where("lat IS NOT NULL")
    held = t("entity").select("business_id", "city_id", F.col("lat").alias("r_lat"),
                              F.col("lng").alias("r_lng"),
                              tx.normalize_name("name_latin").alias("r_name")).where("lat IS NOT NULL")
    near, held = cut(near.where("name <> ''")), cut(held.where("r_name <> ''"))
    alike = near_names.similar_within(near, held, ["city_id"], fv.NEARBY_METERS, settle=cut)
    named = near.withColumn("r_name", F.col("name")).withColumn("similarity", F.lit(100.0))
    equal = spatial.pairs_within(named, held, ["city_id", "r_name"], fv.NEARBY_METERS)
    columns = ["external_id", "business_id", "similarity", (F.col("name") != F.col("r_name")).alias("d")]
    best = rk.first_by(alike.select(*columns).unionByName(equal.select(*columns)), ["external_id"],
                       [-F.col("similarity"), "d", "business_id"])
    return best.select("external_id", F.round("similarity", 6).alias("similarity"))


PARTS_OF_CITY = 64


@query("fn_29_geo_distance", f"""
SELECT l.external_id, e.business_id, round({AWAY}, 3) AS meters FROM listing l
JOIN entity e USING (city_id) WHERE l.lat IS NOT NULL AND e.lat IS NOT NULL""", "listing entity")
def _(t):
    # all pairs of a city: its listings are dealt over parts, so that no task has a whole city
    e = t("entity").where("lat IS NOT NULL").select(
        "business_id", "city_id", F.col("lat").alias("y"), F.col("lng").alias("x"),
        F.explode(F.sequence(F.lit(0), F.lit(PARTS_OF_CITY - 1))).alias("part"))
    rows = t("listing").where("lat IS NOT NULL").select(
        "external_id", "city_id", "lat", "lng",
        F.pmod(F.xxhash64("external_id"), F.lit(PARTS_OF_CITY)).cast("int").alias("part"))
    df = rows.join(e, ["city_id", "part"])
    return df.select("external_id", "business_id",
                     F.round(geo.distance_m("lat", "lng", "y", "x"), 3).alias("meters"))


@query("jn_6_block_list", """
SELECT external_id FROM listing WHERE external_id NOT IN (SELECT external_id FROM listing_link
  JOIN entity_link USING (kind, value) WHERE length(value) = 18)""",
       "listing listing_link entity_link")
def _(t):
    block = t("entity_link").where(F.length("value") == 18).select("kind", "value")
    return fl.drop_blocked(links_of(t), block, ["source_id", "external_id"]).select("external_id")


# one listing at a time, a city's n-th listing in the n-th step; ents: the city's entities so far
SEEN = """seen AS (SELECT l.source_id, l.external_id, e.business_id FROM listing l JOIN entity e
  ON e.business_id = 's' || lpad(substr(l.external_id, 2), 12, '0') WHERE l.k % 9 = 0)"""
SOURCE_RANK = "list_position(" + str(list(fv.SOURCE_ORDER)) + ", source_id)"
WALKED = f"""{SEEN},
names AS (SELECT external_id, source_id, city_id, lat, lng, {norm_sql("name")} AS key FROM listing),
others AS (SELECT city_id, lat, lng, key FROM names UNION ALL
  SELECT city_id, lat, lng, {norm_sql("name_latin")} FROM entity),
{SIMILAR[SIMILAR.index("split AS"):].replace("FROM pairs WHERE a <> '' AND b <> ''",
    f"FROM (SELECT DISTINCT l.key AS a, e.key AS b FROM names l JOIN others e USING (city_id) WHERE "
    f"l.key <> '' AND e.key <> '' AND (e.lat IS NULL OR {AWAY} <= 160)) p")},
alike AS (SELECT a AS key, list(struct_pack(b := b, s := sim)) AS likes FROM sims WHERE sim >= 80
  GROUP BY a),
sites AS (SELECT source_id, external_id, list(kind || ':' || value) AS links FROM listing_link
  GROUP BY ALL),
turns AS (SELECT l.*, coalesce(x.links, CAST([] AS VARCHAR[])) AS links,
    coalesce(k.likes, CAST([] AS STRUCT(b VARCHAR, s DOUBLE)[])) AS likes,
    row_number() OVER (PARTITION BY city_id ORDER BY {SOURCE_RANK}, l.source_id, l.external_id) AS n
  FROM names l LEFT JOIN sites x USING (source_id, external_id) LEFT JOIN alike k USING (key)
  WHERE (l.source_id, l.external_id) NOT IN (SELECT (source_id, external_id) FROM seen)),
holds AS (SELECT business_id, list(DISTINCT link) AS links FROM (
    SELECT business_id, kind || ':' || value AS link FROM entity_link UNION ALL
    SELECT business_id, unnest(links) FROM seen JOIN sites USING (source_id, external_id)) GROUP BY 1),
first AS (SELECT city_id, list(struct_pack(id := business_id, lat := lat, lng := lng,
    key := {norm_sql("name_latin")}, links := coalesce(links, CAST([] AS VARCHAR[])))) AS ents
  FROM entity LEFT JOIN holds USING (business_id) GROUP BY 1),
walk AS (SELECT 0::BIGINT AS n, c.city_id, coalesce(ents, CAST([] AS STRUCT(id VARCHAR, lat DOUBLE,
    lng DOUBLE, key VARCHAR, links VARCHAR[])[])) AS ents, '' AS source_id, '' AS external_id,
    '' AS business_id, '' AS stage
  FROM (SELECT DISTINCT city_id FROM names) c LEFT JOIN first USING (city_id)
  UNION ALL
  SELECT n, city_id, CASE WHEN stage = 'new' THEN list_append(ents, struct_pack(id := id, lat := lat,
      lng := lng, key := key, links := links)) ELSE list_transform(ents, lambda e: CASE WHEN e.id = id
        THEN struct_pack(id := e.id, lat := coalesce(e.lat, lat), lng := coalesce(e.lng, lng),
          key := e.key, links := list_distinct(list_concat(e.links, links))) ELSE e END) END,
    source_id, external_id, id, stage
  FROM (SELECT *, coalesce(by_link, by_name, sha256(source_id || '|' || external_id)) AS id,
      CASE WHEN by_link IS NOT NULL THEN 'link' WHEN by_name IS NOT NULL THEN 'name' ELSE 'new' END
        AS stage
    FROM (SELECT l.*, w.ents, list_min(list_transform(list_filter(w.ents, lambda e:
            len(list_intersect(e.links, l.links)) > 0 AND (l.lat IS NULL OR e.lat IS NULL
              OR {AWAY} <= 1000)), lambda e: e.id)) AS by_link,
          list_min(list_transform(list_filter(w.ents, lambda e: l.lat IS NOT NULL
            AND e.lat IS NOT NULL AND {AWAY} <= 150
            AND len(list_filter(l.likes, lambda x: x.b = e.key)) > 0), lambda e: struct_pack(
              s := -list_filter(l.likes, lambda x: x.b = e.key)[1].s, d := e.key <> l.key,
              id := e.id))).id AS by_name
      FROM walk w JOIN turns l ON l.city_id = w.city_id AND l.n = w.n + 1) t) t)"""


@query("pl_1_resolve_entities", """
SELECT source_id, external_id, business_id, stage FROM walk WHERE n > 0
UNION ALL SELECT source_id, external_id, business_id, 'record' FROM seen""",
       "listing listing_link entity entity_link", WALKED)
def _(t):
    # every ninth listing is the record that its number's entity was first seen in
    records = t("listing").join(t("entity"), F.concat(F.lit("s"), F.lpad(F.substring(
        "external_id", 2, 20), 12, "0")) == F.col("business_id")).where("k % 9 = 0").select(
        "source_id", "external_id", "business_id")
    return resolve_entities(links_of(t), t("entity"), records, t("entity_link"))


@query("wn_8_slug_dedupe", """
SELECT osm_id, CASE WHEN used OR r > 1 THEN CASE WHEN count(*) OVER (PARTITION BY used OR r > 1,
    slug, cc ORDER BY osm_id ROWS UNBOUNDED PRECEDING) > 1 THEN slug || '-' || cc || '-' || osm_id
    ELSE slug || '-' || cc END ELSE slug END AS slug
FROM (SELECT 'n' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS osm_id, lower(c_mktsegment) AS slug,
    CASE c_nationkey % 2 WHEN 0 THEN 'de' ELSE 'fr' END AS cc, c_mktsegment = 'BUILDING' AS used,
    row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS r FROM customer) t""")
def _(t):
    rows = t("customer").select(
        F.concat(F.lit("n"), F.lpad(F.col("c_custkey").cast("string"), 9, "0")).alias("osm_id"),
        F.lower("c_mktsegment").alias("slug"),
        F.when(F.col("c_nationkey") % 2 == 0, "DE").otherwise("FR").alias("country_code"))
    taken = t("customer").where(F.col("c_mktsegment") == "BUILDING").select(
        F.lower("c_mktsegment").alias("slug")).distinct()
    return rk.slug_dedupe(rows, taken).select("osm_id", "slug")


GAZ = """
SELECT 'R' || CAST(c_custkey AS STRING) AS osm_id, CASE c_custkey % 5 WHEN 0 THEN 'city'
    WHEN 1 THEN 'town' WHEN 2 THEN 'peak' WHEN 3 THEN 'suburb' ELSE 'county' END AS kind,
  c_name AS name, CASE c_custkey % 2 WHEN 0 THEN c_mktsegment || CAST(c_custkey AS STRING) END
    AS name_en, CAST(NULL AS STRING) AS name_fa,
  CASE WHEN c_nationkey = 24 THEN 'ir' ELSE 'c' || CAST(c_nationkey % 5 AS STRING) END
    AS country_code, CAST(NULL AS STRING) AS country_name,
  20e0 + CAST(c_custkey % 40 AS DOUBLE) AS lat, -110e0 + CAST(c_custkey % 70 AS DOUBLE) AS lng,
  CASE WHEN c_custkey % 3 = 0 THEN 20e0 + CAST(c_custkey % 40 AS DOUBLE) - 0.25e0 END AS south,
  CASE WHEN c_custkey % 3 = 0 THEN 20e0 + CAST(c_custkey % 40 AS DOUBLE) + 0.25e0 END AS north,
  CASE WHEN c_custkey % 3 = 0 THEN -110e0 + CAST(c_custkey % 70 AS DOUBLE) - 0.5e0 END AS west,
  CASE WHEN c_custkey % 3 = 0 THEN -110e0 + CAST(c_custkey % 70 AS DOUBLE) + 0.5e0 END AS east,
  c_nationkey
FROM {customer}"""


def gazetteer(t):
    spark = t("customer").sparkSession
    df = spark.sql(GAZ, customer=t("customer"))
    return df.withColumn("address", F.create_map(
        F.lit("ISO3166-2-lvl4"), F.concat(F.lit("XX-"), F.col("c_nationkey").cast("string"))))


def known_cities(t):
    return t("city").withColumn("country_code", F.concat(
        F.lit("C"), (F.col("city_id") % 5).cast("string")))


@query("pl_15_build_city_dim", """
SELECT g.osm_id, lower(regexp_replace(coalesce(g.name_en, g.name), '[^A-Za-z0-9]+', '-', 'g')) AS slug,
  round((coalesce(north, lat) + coalesce(south, lat)) / 2 + least(greatest(
    (coalesce(north, lat) - coalesce(south, lat)) / 2 * 1.5, 0.18), 0.6), 3) AS north,
  CAST(c_nationkey AS VARCHAR) AS region
FROM gaz g WHERE kind <> 'peak' AND country_code <> 'ir' AND NOT EXISTS (SELECT 1 FROM city c
  WHERE 'c' || CAST(c.city_id % 5 AS VARCHAR) = g.country_code AND g.lat BETWEEN c.south AND c.north
  AND g.lng BETWEEN c.west AND c.east)""", "city", f"gaz AS ({GAZ.format(customer='customer')})")
def _(t):
    out = city_plan.build_city_dim(gazetteer(t), known_cities(t), t("country"))["cities"]
    return out.select("osm_id", "slug", "north", F.get("regions", F.lit(0)).alias("region"))


@query("fn_25_metro_bbox", """
SELECT osm_id, round((coalesce(west, lng) + coalesce(east, lng)) / 2 - least(greatest(
    (coalesce(east, lng) - coalesce(west, lng)) / 2 * 1.5, 0.18 / greatest(cos(radians(lat)), 0.2)),
    0.6 / greatest(cos(radians(lat)), 0.2)), 3) AS west
FROM gaz""", "", f"gaz AS ({GAZ.format(customer='customer')})")
def _(t):
    box = geo.metro_box("lat", "lng", "south", "north", "west", "east")
    return gazetteer(t).select("osm_id", box["west"].alias("west"))


@query("fn_26_slugify", r"""
SELECT doc_id, coalesce(nullif(trim(regexp_replace(lower(regexp_replace(
  strip_accents(nfc_normalize(text)), '[^\x00-\x7F]', '', 'g')), '[^a-z0-9]+', '-', 'g'), '-'), ''),
  'city') AS slug FROM documents""")
def _(t):
    return t("documents").select("doc_id", tx.slugify("text").alias("slug"))


@query("fn_27_region_code", "SELECT osm_id, CAST(c_nationkey AS VARCHAR) AS region FROM gaz", "",
       f"gaz AS ({GAZ.format(customer='customer')})")
def _(t):
    return gazetteer(t).select("osm_id", address.region_code("address", "country_code")
                               .alias("region"))


NEEDLES = (("gear", "doctor"), ("ring", "beauty"), ("small", "grocery"), ("blue", "bakery"))


def when_sql(col, rules, test):
    return "CASE " + " ".join(f"WHEN {test.format(c=col, v=v)} THEN '{s}'" for v, s in rules) + (
        " ELSE 'other' END")


@query("fn_20_map_needles", "SELECT p_partkey, " + when_sql("p_name", NEEDLES, "contains({c}, '{v}')")
       + " AS slug FROM part")
def _(t):
    return t("part").select("p_partkey", categories.map_needles("p_name", NEEDLES).alias("slug"))


CODES = (("10", "restaurant"), ("1", "bakery"), ("21", "doctor"), ("2", "lawyer"), ("92", "beauty"))


@query("fn_19_map_prefix", "SELECT p_partkey, " + when_sql("CAST(p_partkey AS VARCHAR)", CODES,
       "starts_with({c}, '{v}')") + " AS first, " + when_sql("CAST(p_partkey AS VARCHAR)",
       sorted(CODES, key=lambda r: -len(r[0])), "starts_with({c}, '{v}')") + " AS longest FROM part")
def _(t):
    code = F.col("p_partkey").cast("string")
    return t("part").select("p_partkey", categories.map_prefix(code, CODES).alias("first"),
                            categories.map_prefix(code, CODES, longest=True).alias("longest"))


@query("fn_17_map_category", """
SELECT p_partkey, CASE WHEN p_name LIKE '% gear' THEN 'doctor' WHEN p_name LIKE 'red %' THEN 'bakery'
  WHEN p_type = 'PROMO' THEN 'grocery' ELSE 'other' END AS slug FROM part""")
def _(t):
    slug = categories.map_hierarchy(F.split("p_name", " "), "p_type",
                                    {"red": "bakery", "gear": "doctor"}, {"PROMO": "grocery"})
    return t("part").select("p_partkey", slug.alias("slug"))


@query("fn_18_map_tags", """
SELECT p_partkey, CASE WHEN p_type = 'SMALL' OR p_brand = 'Brand#3' THEN 'beauty'
  WHEN p_size > 25 THEN 'doctor' ELSE 'other' END AS slug FROM part""")
def _(t):
    tags = F.map_concat(
        F.create_map(F.lit("kind"), F.concat_ws(";", "p_type", "p_brand")),
        F.when(F.col("p_size") > 25, F.create_map(F.lit("big"), F.lit("x"))).otherwise(
            F.create_map(F.lit("none"), F.lit(""))))
    rules = [("kind=SMALL", "beauty"), ("kind=Brand#3", "beauty"), ("big=*", "doctor")]
    return t("part").select("p_partkey", categories.map_tags(tags, rules).alias("slug"))


@query("fn_21_nonprofit_category", """
SELECT c_custkey, CASE WHEN starts_with(c_mktsegment, 'B') OR c_custkey % 2 = 0 THEN 'education'
  ELSE 'community' END AS slug FROM customer""")
def _(t):
    name = F.when(F.col("c_custkey") % 2 == 0, "Old School").otherwise("Club")
    return t("customer").select("c_custkey", categories.nonprofit_category(name, "c_mktsegment")
                                .alias("slug"))


@query("fn_15_clean_address", """
SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) || ' ' || o_orderpriority || ' ST, TORONTO, ON, M2M '
  || CAST(o_orderkey % 10 AS VARCHAR) || 'S9' AS address FROM orders""")
def _(t):
    key = F.col("o_orderkey").cast("string")
    raw = F.concat(F.lit("12 - "), key, F.lit(" "), "o_orderpriority",
                   F.lit(" ST, #3, B, TORONTO, SUITE 7, ON, M2M "),
                   (F.col("o_orderkey") % 10).cast("string"), F.lit("S9"))
    return t("orders").select("o_orderkey", address.clean_address(raw).alias("address"))


@query("fn_16_postal_code", """
SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'M2M ' || CAST(o_orderkey % 10 AS VARCHAR) || 'S9'
  WHEN 1 THEN '9' || lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0') END AS code FROM orders""")
def _(t):
    three = F.col("o_orderkey") % 3
    raw = F.when(three == 0, F.concat(F.lit("1 A ST, ON, M2M "), (F.col("o_orderkey") % 10)
                                      .cast("string"), F.lit("S9"))).when(
        three == 1, F.concat(F.lit("10000 B ST, CA 9"), F.lpad(
            (F.col("o_orderkey") % 10000).cast("string"), 4, "0"))).otherwise("99999 C ST, 1 CA")
    return t("orders").select("o_orderkey", address.postal_code(raw).alias("code"))


@query("jn_11_geocode_join", """
SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 1e0 * s WHEN 1 THEN 2e0 END AS lat,
  c_custkey % 4 <> 3 AS geocoded FROM (SELECT *, c_nationkey AS s FROM customer) t""")
def _(t):
    # streets of customers 0 (mod 4) are known, 1 through the post code, 2 is a known miss
    four = F.col("c_custkey") % 4
    key = F.col("c_custkey").cast("string")
    street = F.concat(key, F.lit(" MAIN ST, TORONTO"))
    rows = t("customer").select("c_custkey", F.when(four == 1, F.concat(
        street, F.lit(", M2M 3S9"))).otherwise(street).alias("address"),
        F.lit("CA").alias("country_code"))
    known = t("customer").where(four.isin(0, 2)).select(
        F.concat(street, F.lit(" | ca")).alias("query"),
        F.when(four == 0, F.col("c_nationkey").cast("double")).alias("lat"),
        F.when(four == 0, F.lit(1.0)).alias("lng"))
    post = t("region").where("r_regionkey = 0").select(
        F.lit("M2M 3S9 | ca").alias("query"), F.lit(2.0).alias("lat"), F.lit(1.0).alias("lng"))
    out = fl.geocode_join(rows, known.unionByName(post))
    return out.select("c_custkey", "lat", "geocoded")


@query("jn_14_registry_links", """
SELECT DISTINCT c.slug, 'reg' || CAST(n.n_nationkey AS VARCHAR) AS registry FROM city c JOIN nation n
  ON c.region = 'S' || CAST(n.n_nationkey % 4 AS VARCHAR)
  OR c.country_code = 'R' || CAST(n.n_nationkey % 5 AS VARCHAR)
WHERE n.n_nationkey % 3 <> 0""", "city")
def _(t):
    cities = t("city").withColumn("regions", F.array("region"))
    key = F.col("n_nationkey")
    registries = t("nation").select(
        F.concat(F.lit("reg"), key.cast("string")).alias("id"),
        F.array(F.concat(F.lit("S"), (key % 4).cast("string")),
                F.concat(F.lit("country:R"), (key % 5).cast("string"))).alias("regions"),
        F.array(F.when(key % 3 == 0, "lawyer").when(key % 3 == 1, "doctor/dentist")
                .otherwise("doctor")).alias("categories"))
    return fl.registry_links(cities, registries, ["doctor"])


@query("st_5_region_intersection", """
SELECT c.slug, s.s_suppkey FROM city c JOIN supplier s ON s.s_nationkey = c.city_id
WHERE c.region IN ('S' || CAST(s.s_suppkey % 4 AS VARCHAR), 'S9')""", "city")
def _(t):
    s = t("supplier").select("s_suppkey", F.col("s_nationkey").cast("long").alias("city_id"),
                             F.array(F.concat(F.lit("S"), (F.col("s_suppkey") % 4).cast("string")),
                                     F.lit("S9")).alias("theirs"))
    df = t("city").withColumn("regions", F.array("region")).join(s, "city_id")
    return df.where(fl.region_overlap("regions", "theirs")).select("slug", "s_suppkey")


NOW = "2001-08-01 00:00:00"


@query("pl_10_due_cities", f"""
SELECT slug, reason FROM (SELECT c.slug, CASE WHEN s.last_indexed_at IS NULL THEN 'never_indexed'
    WHEN s.last_indexed_at < TIMESTAMP '{NOW}' - INTERVAL 2 DAYS THEN 'stale'
    WHEN s.release < 'r6' THEN 'new_overture_release' END AS reason
  FROM city c LEFT JOIN city_status s USING (city_id) WHERE c.enabled) t
WHERE reason IS NOT NULL""", "city city_status")
def _(t):
    status = t("city_status").withColumn("last_indexed_at",
                                         F.col("last_indexed_at").cast("timestamp"))
    return schedule.due_cities(t("city"), status, NOW, "r6", days=2)


@query("jn_16_index_status_outer", """
SELECT c.slug, CAST(s.last_indexed_at AS DATE)::VARCHAR AS day FROM city c
LEFT JOIN city_status s USING (city_id)""", "city city_status")
def _(t):
    joined = t("city").join(t("city_status"), "city_id", "left")
    return joined.select("slug", F.to_date("last_indexed_at").cast("string").alias("day"))


@query("sc_20_sitemap_rows", """
SELECT 'https://site.example/' || lang || '/' || slug || part AS url, day AS last_modified
FROM (SELECT slug, CAST(last_indexed_at AS DATE)::VARCHAR AS day, city_id FROM city
  LEFT JOIN city_status USING (city_id)) c CROSS JOIN (VALUES ('fa'), ('en')) AS l(lang)
JOIN (SELECT city_id, '' AS part FROM city UNION ALL SELECT DISTINCT city_id, '/' || category
  FROM listing WHERE k % 3 = 0) p USING (city_id)""", "city city_status listing")
def _(t):
    counts = t("listing").groupBy("city_id", "category").agg(F.count_if(F.col("k") % 3 == 0)
                                                             .alias("n"))
    maps = counts.groupBy("city_id").agg(F.map_from_entries(F.collect_list(
        F.struct("category", "n"))).alias("category_counts"))
    df = t("city").join(t("city_status"), "city_id", "left").join(maps, "city_id", "left")
    df = df.withColumn("last_indexed_at", F.to_date("last_indexed_at").cast("string"))
    return dims.sitemap_rows(df, ["fa", "en"], "https://site.example")


@query("sc_18_upsert_sink", """
SELECT coalesce(n.k, o.k) AS id, coalesce(n.name, o.name) AS name, CASE WHEN n.k IS NULL THEN o.on_
  WHEN o.k IS NULL THEN n.on_ ELSE o.on_ AND n.on_ END AS enabled
FROM (SELECT c_custkey AS k, c_name AS name, c_custkey % 3 <> 0 AS on_ FROM customer
  WHERE c_custkey % 2 = 0) o
FULL JOIN (SELECT c_custkey AS k, c_mktsegment AS name, c_custkey % 5 <> 0 AS on_ FROM customer
  WHERE c_custkey % 4 <> 3) n ON o.k = n.k""")
def _(t):
    key = F.col("c_custkey")
    old = t("customer").where(key % 2 == 0).select(key.alias("id"), F.col("c_name").alias("name"),
                                                   (key % 3 != 0).alias("enabled"))
    new = t("customer").where(key % 4 != 3).select(
        key.alias("id"), F.col("c_mktsegment").alias("name"), (key % 5 != 0).alias("enabled"))
    return up.upsert(old, new, ["id"], {"enabled": up.keep_switched_off})


@query("pf_13_source_enabled", """
SELECT s_suppkey FROM supplier WHERE s_suppkey % 3 <> 0 AND s_nationkey % 4 <> 0
  AND s_acctbal > 0""")
def _(t):
    df = t("supplier").select(
        "s_suppkey", (F.col("s_suppkey") % 3 == 0).alias("account_required"),
        F.when(F.col("s_nationkey") % 4 == 0, "rejected").otherwise("mvp").alias("status"),
        (F.col("s_acctbal") > 0).alias("enabled"))
    return fl.source_enabled(df).select("s_suppkey")


def suggestions_of(t):
    key = F.col("c_custkey")
    kind = F.when(key % 4 == 0, "city").when(key % 4 == 1, "village").when(
        key % 4 == 2, "town").otherwise("peak")
    return t("customer").select(
        F.when(key % 9 != 0, "place").otherwise("highway").alias("osm_key"),
        kind.alias("osm_value"), F.lit("R").alias("osm_type"), (key % 700).alias("osm_id"),
        F.col("c_mktsegment").alias("name"), F.lit(None).cast("string").alias("state"),
        F.lit("x").alias("country"), F.when(F.col("c_nationkey") == 3, "ir").otherwise("ca")
        .alias("countrycode"), key.alias("ord"))


SUGGEST = """
kept AS (SELECT 'R' || CAST(c_custkey % 700 AS VARCHAR) AS osm_id, c_mktsegment AS name,
  c_custkey AS ord, CASE c_custkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 3 ELSE 1 END AS rank
  FROM customer WHERE c_custkey % 9 <> 0 AND c_custkey % 4 <> 3 AND c_nationkey <> 3),
firsts AS (SELECT osm_id, name, arg_min(rank, ord) AS rank, min(ord) AS ord FROM kept GROUP BY 1, 2)"""


@query("pf_11_settlement_filter", "SELECT osm_id, name, rank, ord FROM firsts", "", SUGGEST)
def _(t):
    return rk.settlement_filter(suggestions_of(t)).select("osm_id", "name", "rank", "ord")


@query("so_5_suggestions_topk", "SELECT osm_id, name FROM firsts ORDER BY rank, ord LIMIT 8", "",
       SUGGEST)
def _(t):
    return rk.suggestions(suggestions_of(t)).select("osm_id", "name")


@query("wn_4_latest_per_key", """
SELECT p_brand, p_type, max(p_size) AS year, arg_max(p_partkey, p_size * 10000000 - p_partkey) AS k
FROM part GROUP BY 1, 2""")
def _(t):
    best = rk.first_by(t("part"), ["p_brand", "p_type"], [-F.col("p_size"), "p_partkey"])
    return best.select("p_brand", "p_type", F.col("p_size").alias("year"),
                       F.col("p_partkey").alias("k"))


@query("st_3_merge_sources", """
SELECT source, count(*) AS n, count(address) AS with_address FROM (
  SELECT 'customer' AS source, CAST(NULL AS VARCHAR) AS address FROM customer
  UNION ALL SELECT 'supplier', s_name FROM supplier UNION ALL SELECT 'part', NULL FROM part) t
GROUP BY 1""")
def _(t):
    frames = [t("customer").select(F.lit("customer").alias("source"), "c_name"),
              t("supplier").select(F.lit("supplier").alias("source"),
                                   F.col("s_name").alias("address")),
              t("part").select(F.lit("part").alias("source"))]
    return up.merge_sources(*frames).groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.count("address").alias("with_address"))


@query("pl_2_assign_city", f"SELECT l.external_id, c.city_id, c.country_code FROM listing l {CITY_OF}",
       "listing city")
def _(t):
    return index.assign_city(t("listing").drop("city_id"), t("city")).select(
        "external_id", "city_id", "country_code")
