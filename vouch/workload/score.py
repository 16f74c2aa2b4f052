"""Evidence, counts, coverage, precision, search over orders and lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from vouch.functions import scoring
from vouch.functions.geo import distance_m
from vouch.functions.links import map_urls
from vouch.operators import analytics as an
from vouch.operators import evidence as ev
from vouch.operators import filters as fl
from vouch.operators import ranking as rk
from vouch.plans import moderation, search
from vouch.workload.views import query

# check SQL shared by the score family: business with score, label, threshold, shown
SCORED = """
best AS (SELECT business_id, signal, max(weight) AS w FROM evidence GROUP BY 1, 2),
fused AS (SELECT business_id,
    CAST(round(CAST((1 - coalesce(product(1 - w) FILTER (signal <> 'negative_keyword'), 1))
      * CASE WHEN bool_or(signal = 'negative_keyword') THEN 0.7 ELSE 1 END AS DECIMAL(18, 9)), 4)
      AS DOUBLE) AS score
  FROM best GROUP BY 1),
scored AS (SELECT b.*, coalesce(f.score, 0.0) AS score,
    CASE WHEN f.score >= 0.75 THEN 'high' WHEN f.score >= 0.45 THEN 'medium'
      WHEN f.score >= 0.25 THEN 'low' END AS label
  FROM business b LEFT JOIN fused f USING (business_id))"""
SHOWN = SCORED + """,
shown AS (SELECT s.* FROM scored s JOIN city c USING (city_id)
  LEFT JOIN country o ON o.code = c.country_code
  WHERE s.status = 'active' AND s.score >= coalesce(o.min_display_score, 0.25))"""
V = "business evidence city country"


def scored(t):
    return ev.rescore(t("business"), t("evidence"))


def shown(t):
    return ev.shown(scored(t), t("city"), t("country"))


@query("ag_1_best_per_signal", """
SELECT business_id, signal, max(weight) AS weight,
  min(CASE WHEN weight = w THEN ord END) AS ord
FROM (SELECT *, max(weight) OVER (PARTITION BY business_id, signal) AS w FROM evidence) t
GROUP BY 1, 2""", "evidence")
def _(t):
    best = ev.best_per_signal(t("evidence"), ["business_id"], ["ord"])
    return best.select("business_id", "signal", "weight", "ord")


@query("ag_2_noisy_or", "SELECT business_id, score FROM fused", "business evidence", SCORED)
def _(t):
    return ev.noisy_or(t("evidence"), ["business_id"])


@query("ag_2_noisy_or_by_supplier", """
SELECT k AS business_id, CAST(round(CAST((1 - coalesce(product(1 - w)
    FILTER (signal <> 'negative_keyword'), 1)) * CASE WHEN bool_or(signal = 'negative_keyword')
    THEN 0.7 ELSE 1 END AS DECIMAL(18, 9)), 4) AS DOUBLE) AS score
FROM (SELECT ord % 50 AS k, signal, max(weight / 2) AS w FROM evidence GROUP BY 1, 2) t
GROUP BY 1""", "evidence")
def _(t):
    # few keys with very many rows each
    fan_in = t("evidence").select((F.col("ord") % 50).alias("business_id"), "signal",
                                  (F.col("weight") / 2).alias("weight"))
    return ev.noisy_or(fan_in, ["business_id"])


@query("ag_3_confidence_label", "SELECT business_id, score, label FROM scored",
       "business evidence", SCORED)
def _(t):
    return scored(t).select("business_id", "score", "label")


@query("pl_6_rescore", "SELECT city_id, label, count(*) AS n, sum(score) AS total FROM (SELECT "
       "city_id, label, CAST(score AS DECIMAL(18, 4)) AS score FROM scored) t GROUP BY 1, 2",
       "business evidence", SCORED)
def _(t):
    df = scored(t).withColumn("score", F.col("score").cast("decimal(18,4)"))
    return df.groupBy("city_id", "label").agg(F.count(F.lit(1)).alias("n"),
                                              F.sum("score").alias("total"))


@query("jn_15_evidence_outer", """
SELECT b.business_id, count(e.signal) AS rows_of_evidence
FROM business b LEFT JOIN evidence e USING (business_id) GROUP BY 1""", "business evidence")
def _(t):
    joined = ev.evidence_outer(t("business").select("business_id"), t("evidence"))
    return joined.groupBy("business_id").agg(F.count("signal").alias("rows_of_evidence"))


@query("pf_4_is_shown", "SELECT business_id, city_id, score FROM shown", V, SHOWN)
def _(t):
    return shown(t).select("business_id", "city_id", "score")


@query("jn_12_country_threshold", """
SELECT b.business_id, coalesce(o.min_display_score, 0.25) AS threshold
FROM business b LEFT JOIN city c USING (city_id) LEFT JOIN country o ON o.code = c.country_code
""", "business city country")
def _(t):
    return ev.with_threshold(t("business"), t("city"), t("country")).select(
        "business_id", "threshold")


@query("pf_5_min_confidence", """
SELECT s.business_id, s.score FROM scored s LEFT JOIN city c USING (city_id)
LEFT JOIN country o ON o.code = c.country_code
WHERE s.score >= greatest(0.45, coalesce(o.min_display_score, 0.25))""", V, SCORED)
def _(t):
    df = ev.with_threshold(scored(t), t("city"), t("country"))
    return df.where(F.col("score") >= scoring.min_confidence("medium", "threshold")).select(
        "business_id", "score")


@query("ag_4_category_counts", """
SELECT city_id, slug, count(*) AS n FROM shown JOIN business_category USING (business_id)
GROUP BY 1, 2""", V + " business_category", SHOWN)
def _(t):
    return an.category_counts(shown(t), t("business_category"))


@query("ag_5_top_category_counts", """
SELECT c.city_id, t.slug, t.n FROM city c LEFT JOIN (
  SELECT s.city_id, coalesce(k.parent_slug, b.slug) AS slug, count(DISTINCT business_id) AS n
  FROM shown s JOIN business_category b USING (business_id) LEFT JOIN category k ON k.slug = b.slug
  GROUP BY 1, 2) t USING (city_id)""", V + " business_category category", SHOWN)
def _(t):
    return an.top_category_counts(shown(t), t("business_category"), t("category"), t("city"))


@query("ag_6_source_counts", """
SELECT city_id, source_id, count(DISTINCT business_id) AS n
FROM shown JOIN record USING (business_id) GROUP BY 1, 2""", V + " record", SHOWN)
def _(t):
    return an.source_counts(shown(t), t("record"))


@query("ag_7_social_counts", """
SELECT city_id, kind, count(DISTINCT business_id) AS n FROM shown JOIN link USING (business_id)
WHERE kind IN ('facebook', 'instagram', 'telegram') GROUP BY 1, 2""", V + " link", SHOWN)
def _(t):
    return an.social_counts(shown(t), t("link"))


@query("ag_8_multi_source", """
SELECT city_id, count(*) AS n FROM shown JOIN (SELECT business_id FROM record GROUP BY 1
  HAVING count(DISTINCT source_id) >= 2) m USING (business_id) GROUP BY 1""", V + " record", SHOWN)
def _(t):
    return an.multi_source(shown(t), t("record"))


COVERAGE = SHOWN + """,
named AS (SELECT city_id, source_id AS name, count(DISTINCT business_id) AS n, 1 AS own
    FROM shown JOIN record USING (business_id) GROUP BY 1, 2
  UNION ALL SELECT city_id, kind, count(DISTINCT business_id), 0
    FROM shown JOIN link USING (business_id)
    WHERE kind IN ('facebook', 'instagram', 'telegram') GROUP BY 1, 2),
multi AS (SELECT city_id, count(*) AS n FROM shown JOIN (SELECT business_id FROM record GROUP BY 1
  HAVING count(DISTINCT source_id) >= 2) m USING (business_id) GROUP BY 1),
totals AS (SELECT city_id, count(*) AS n FROM shown GROUP BY 1)"""


@query("ag_9_coverage", """
SELECT c.slug AS city, coalesce(t.n, 0) AS shown, coalesce(a.sources, '') AS sources,
  coalesce(a.own, 0) AS source_count, coalesce(m.n, 0) AS multi_source
FROM city c LEFT JOIN totals t USING (city_id) LEFT JOIN multi m USING (city_id) LEFT JOIN (
  SELECT city_id, string_agg(name || '=' || CAST(n AS VARCHAR), ',' ORDER BY name) AS sources,
    CAST(sum(own) AS BIGINT) AS own FROM named GROUP BY 1) a USING (city_id)""",
       V + " record link", COVERAGE)
def _(t):
    df = an.coverage(t("city"), shown(t), t("record"), t("link"))
    pairs = F.transform(F.array_sort(F.map_entries("sources")),
                        lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return df.withColumn("sources", F.array_join(pairs, ","))


WIDE = ["src0", "src1", "src2", "src3", "facebook", "instagram", "telegram"]


@query("sc_19_coverage_sink", "SELECT c.slug AS city, coalesce(t.n, 0) AS shown, "
       + ", ".join(f"coalesce((SELECT n FROM named WHERE name = '{n}' AND city_id = c.city_id), 0)"
                   f" AS {n}" for n in WIDE)
       + " FROM city c LEFT JOIN totals t USING (city_id)", V + " record link", COVERAGE)
def _(t):
    df = an.coverage(t("city"), shown(t), t("record"), t("link"))
    return an.coverage_table(df, WIDE).drop("source_count", "multi_source")


LEVELS = "(VALUES ('high'), ('medium'), ('low')) AS l(level)"


def _precision_sql(counted: str, extra_col: str = "") -> str:
    p = f"{extra_col}{', ' if extra_col else ''}"
    return f"""
SELECT {p}level, n AS labeled, h AS hits,
  CASE WHEN n > 0 THEN CAST(round(CAST(h * 1.0 / n AS DECIMAL(18, 9)), 3) AS DOUBLE) END
    AS precision,
  CASE WHEN n > 0 THEN CAST(round(CAST(greatest(0, centre - margin) AS DECIMAL(18, 9)), 3)
    AS DOUBLE) ELSE 0.0 END AS ci_low,
  CASE WHEN n > 0 THEN CAST(round(CAST(least(1, centre + margin) AS DECIMAL(18, 9)), 3)
    AS DOUBLE) ELSE 0.0 END AS ci_high
FROM (SELECT *, (p + 1.96e0 * 1.96e0 / (2 * n)) / (1 + 1.96e0 * 1.96e0 / n) AS centre,
    1.96e0 * sqrt(p * (1 - p) / n + 1.96e0 * 1.96e0 / (4e0 * n * n))
      / (1 + 1.96e0 * 1.96e0 / n) AS margin
  FROM (SELECT *, CASE WHEN n > 0 THEN CAST(h AS DOUBLE) / n END AS p FROM ({counted}) c) d) e"""


@query("ag_11_precision_by_level", _precision_sql(f"""
SELECT l.level, count(x.business_id) AS n, count(x.business_id) FILTER (x.verdict) AS h
FROM {LEVELS} LEFT JOIN (SELECT s.business_id, s.label, v.verdict FROM scored s
  JOIN label v USING (business_id)) x ON x.label = l.level GROUP BY 1"""),
       "business evidence label", SCORED)
def _(t):
    joined = t("label").join(scored(t).select("business_id", F.col("label").alias("level")),
                             "business_id")
    return an.precision_by_level(joined)


@query("jn_19_label_join", """
SELECT business_id, verdict, score, s.label FROM label v JOIN scored s USING (business_id)""",
       "business evidence label", SCORED)
def _(t):
    return t("label").select("business_id", "verdict").join(
        scored(t).select("business_id", "score", "label"), "business_id")


@query("ag_12_precision_overall", """
SELECT n AS labeled, h AS hits,
  CAST(round(CAST(h * 1.0 / n AS DECIMAL(18, 9)), 3) AS DOUBLE) AS high_and_medium,
  CAST(0.9 AS DOUBLE) AS goal, coalesce(h * 1.0 / n >= 0.9, false) AS met, 100 AS target_per_level
FROM (SELECT count(*) AS n, count(*) FILTER (v.verdict) AS h FROM scored s
  JOIN label v USING (business_id) WHERE s.label IN ('high', 'medium')) t""",
       "business evidence label", SCORED)
def _(t):
    joined = t("label").join(scored(t).select("business_id", F.col("label").alias("level")),
                             "business_id")
    return an.precision_overall(joined)


SCENARIOS = {"as_is": {}, "low_af": {"AF": 0.1}, "no_nf": {"NF": 0.0, "NO": 0.2}}


@query("ag_13_what_if_weights", _precision_sql(f"""
SELECT sc.scenario, l.level, count(y.business_id) AS n, count(y.business_id) FILTER (y.verdict)
  AS h
FROM (VALUES ('as_is'), ('low_af'), ('no_nf')) AS sc(scenario) CROSS JOIN {LEVELS}
LEFT JOIN (SELECT scenario, business_id, verdict, CASE WHEN score >= 0.75 THEN 'high'
    WHEN score >= 0.45 THEN 'medium' WHEN score >= 0.25 THEN 'low' END AS level
  FROM (SELECT scenario, v.business_id, v.verdict, CAST(round(CAST(
      (1 - coalesce(product(1 - CASE scenario || signal WHEN 'low_afAF' THEN 0.1
        WHEN 'no_nfNF' THEN 0.0 WHEN 'no_nfNO' THEN 0.2 ELSE weight END)
        FILTER (signal <> 'negative_keyword'), 1))
      * CASE WHEN bool_or(signal = 'negative_keyword') THEN 0.7 ELSE 1 END
      AS DECIMAL(18, 9)), 4) AS DOUBLE) AS score
    FROM (VALUES ('as_is'), ('low_af'), ('no_nf')) AS sc(scenario) CROSS JOIN label v
    LEFT JOIN (SELECT business_id, signal, max(weight) AS weight FROM evidence GROUP BY 1, 2) e
      USING (business_id) GROUP BY 1, 2, 3) z) y
  ON y.scenario = sc.scenario AND y.level = l.level GROUP BY 1, 2""", "scenario"),
       "evidence label")
def _(t):
    return an.what_if(t("evidence"), t("label"), SCENARIOS)


@query("ag_15_run_stats", """
SELECT coalesce(a.source_id, b.source_id) AS source_id, coalesce(a.seen, 0) AS seen,
  coalesce(a.stored, 0) AS stored, coalesce(b.removed, 0) AS removed,
  CAST(NULL AS VARCHAR) AS error
FROM (SELECT source_id, count(*) AS seen, count(*) FILTER (weight > 0.2) AS stored
  FROM evidence GROUP BY 1) a
FULL JOIN (SELECT source_id, count(*) AS removed FROM record
  WHERE fetched_at < TIMESTAMP '1996-01-01' GROUP BY 1) b ON a.source_id = b.source_id""",
       "evidence record")
def _(t):
    seen = t("evidence").select("source_id", (F.col("weight") > 0.2).alias("stored"))
    removed = t("record").where(F.col("fetched_at") < F.lit("1996-01-01").cast("timestamp_ntz"))
    errors = removed.where(F.lit(False)).select(
        "source_id", F.lit(None).cast("string").alias("error"))
    return an.run_stats(seen, removed.select("source_id"), errors)


@query("ag_16_country_city_counts", """
SELECT o.code, o.name_en, count(c.city_id) AS city_count FROM country o
LEFT JOIN city c ON c.country_code = o.code WHERE o.enabled GROUP BY 1, 2""", "city country")
def _(t):
    return an.country_city_counts(t("country"), t("city"))


@query("ag_21_label_progress", f"""
SELECT level, n AS labels, row_number() OVER (ORDER BY n, CASE level WHEN 'high' THEN 0
  WHEN 'medium' THEN 1 ELSE 2 END) AS need
FROM (SELECT l.level, count(x.business_id) AS n FROM {LEVELS} LEFT JOIN (SELECT s.business_id,
  s.label FROM label v JOIN scored s USING (business_id)) x ON x.label = l.level GROUP BY 1) t""",
       "business evidence label", SCORED)
def _(t):
    return an.label_progress(t("label"), scored(t))


@query("wn_1_first_link_per_entity", """
SELECT business_id, url FROM (SELECT *, row_number() OVER (PARTITION BY business_id
  ORDER BY link_id, url) AS r FROM link WHERE kind = 'website') t WHERE r = 1""", "link")
def _(t):
    return rk.first_link_per_entity(t("link"), "website", ["link_id", "url"]).select(
        "business_id", "url")


@query("wn_2_first_record_per_source", """
SELECT business_id, source, url FROM (SELECT *, row_number() OVER (
    PARTITION BY business_id, source ORDER BY prio, seen NULLS FIRST, ord, url) AS r
  FROM (SELECT business_id, source_id AS source, 0 AS prio, fetched_at AS seen, 0 AS ord, url
      FROM record
    UNION ALL SELECT business_id, kind, 1, NULL, link_id, url FROM link
      WHERE kind IN ('facebook', 'instagram', 'telegram')) u) t WHERE r = 1""", "record link")
def _(t):
    records = t("record").withColumn("fetched_at", F.col("fetched_at").cast("timestamp"))
    return rk.first_record_per_source(records, t("link").withColumn("ord", F.col("link_id")))


@query("wn_3_evidence_order", """
SELECT business_id, signal, ord, weight, row_number() OVER (PARTITION BY business_id
  ORDER BY weight DESC, ord, signal) AS position FROM evidence""", "evidence")
def _(t):
    return rk.evidence_rank(t("evidence"), ["ord", "signal"]).select(
        "business_id", "signal", "ord", "weight", "position")


@query("wn_5_survivorship", """
SELECT business_id, arg_min(a, fetched_at || external_id) FILTER (a IS NOT NULL) AS first_url,
  arg_min(b, fetched_at || external_id) FILTER (b IS NOT NULL) AS first_source
FROM (SELECT business_id, CAST(fetched_at AS VARCHAR) AS fetched_at, external_id,
  CASE WHEN length(url) % 2 = 0 THEN url END AS a,
  CASE WHEN source_id <> 'src1' THEN source_id END AS b FROM record) t GROUP BY 1""", "record")
def _(t):
    rows = t("record").select(
        "business_id", "fetched_at", "external_id",
        F.when(F.length("url") % 2 == 0, F.col("url")).alias("first_url"),
        F.when(F.col("source_id") != "src1", F.col("source_id")).alias("first_source"))
    return rk.survivorship(rows, "business_id", ["first_url", "first_source"],
                           ["fetched_at", "external_id"])


@query("wn_6_label_sample", """
SELECT business_id, level, r AS position FROM (SELECT business_id, label AS level,
  row_number() OVER (PARTITION BY label ORDER BY md5('7|' || CAST(business_id AS VARCHAR)),
    business_id) AS r
  FROM shown WHERE label IS NOT NULL AND business_id NOT IN (SELECT business_id FROM label)) t
WHERE r <= 20""", V + " label", SHOWN)
def _(t):
    return rk.label_sample(shown(t), t("label"), 20, seed="7")


@query("jn_7_category_semi", """
SELECT business_id FROM shown WHERE business_id IN (SELECT business_id FROM business_category
  WHERE slug IN (SELECT slug FROM category WHERE slug IN ('promo', 'large')
    OR parent_slug IN ('promo', 'large')))""", V + " business_category category", SHOWN)
def _(t):
    slugs = fl.category_expand(t("category"), ["promo", "large"])
    return fl.in_categories(shown(t), t("business_category"), slugs).select("business_id")


@query("jn_8_source_or_link_semi", """
SELECT business_id FROM shown WHERE business_id IN (SELECT business_id FROM record
  WHERE source_id = 'src2') OR business_id IN (SELECT business_id FROM link
  WHERE kind = 'instagram')""", V + " record link", SHOWN)
def _(t):
    return fl.from_sources(shown(t), t("record"), t("link"), ["src2", "instagram"]).select(
        "business_id")


@query("jn_9_unlabelled_anti", """
SELECT business_id FROM shown s WHERE NOT EXISTS (SELECT 1 FROM label v
  WHERE v.business_id = s.business_id)""", V + " label", SHOWN)
def _(t):
    return fl.unlabelled(shown(t), t("label")).select("business_id")


@query("jn_10_orphan_anti", """
SELECT business_id FROM business b WHERE NOT EXISTS (SELECT 1 FROM record r
  WHERE r.business_id = b.business_id)""", "business record")
def _(t):
    return fl.orphans(t("business"), t("record")).select("business_id")


@query("jn_13_category_expand", """
SELECT DISTINCT slug FROM category WHERE slug IN ('promo', 'small/brand3')
  OR parent_slug IN ('promo', 'small/brand3')""", "category")
def _(t):
    return fl.category_expand(t("category"), ["promo", "small/brand3"])


@query("so_6_nest_hierarchy", """
SELECT p.slug, p.position, coalesce(string_agg(c.slug, ' ' ORDER BY c.position, c.slug), '')
  AS children
FROM category p LEFT JOIN category c ON c.parent_slug = p.slug WHERE p.parent_slug IS NULL
GROUP BY 1, 2""", "category")
def _(t):
    df = rk.nest_hierarchy(t("category"))
    return df.withColumn("children", F.array_join("children", " "))


@query("so_7_hidden_list", "SELECT business_id, name_latin FROM business WHERE status = 'hidden'",
       "business")
def _(t):
    return rk.hidden_list(t("business")).select("business_id", "name_latin")


FOUND = SHOWN + """,
found AS (SELECT * FROM shown WHERE city_id = 3 AND business_id IN (SELECT business_id
  FROM business_category JOIN category USING (slug)
  WHERE slug IN ('promo', 'large', 'economy') OR parent_slug IN ('promo', 'large', 'economy')))"""
FOUND_VIEWS = V + " business_category category"
WANTED = ["promo", "large", "economy"]


def found(t, level="low", sources=None):
    return search.search_results(
        scored(t), t("business_category"), t("record"), t("link"), t("city"), t("country"),
        t("category"), city="nation-3", country="R3", wanted=WANTED, level=level,
        sources=sources)


@query("so_1_search_page", """
SELECT business_id, name_latin, score FROM found ORDER BY score DESC, name_latin, business_id
LIMIT 20 OFFSET 20""", FOUND_VIEWS, FOUND)
def _(t):
    return rk.search_page(found(t), "confidence", 2, 20).select("business_id", "name_latin",
                                                                "score")


@query("so_1_search_page_after", """
SELECT business_id, name_latin, score FROM found ORDER BY score DESC, name_latin, business_id
LIMIT 20 OFFSET 60""", FOUND_VIEWS, FOUND)
def _(t):
    # the caller keeps the cursor of the last row of the third page
    seen = rk.search_page(found(t), "confidence", 3, 20).select(
        rk.page_key("confidence").alias("cursor"))
    cursor = seen.agg(F.max("cursor").alias("cursor")).first().cursor
    page = found(t).where("false") if cursor is None else rk.search_page(
        found(t), "confidence", 1, 20, after=tuple(cursor))
    return page.select("business_id", "name_latin", "score")


@query("so_1_search_page_by_distance", """
SELECT business_id, name_latin FROM found ORDER BY round(2 * 6371008.8 * asin(sqrt(least(1.0,
    pow(sin((radians(32.0) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(32.0))
    * pow(sin(radians(-68.0 - lng) / 2), 2)))), 3) NULLS LAST, name_latin, business_id
LIMIT 20""", FOUND_VIEWS, FOUND)
def _(t):
    # the check rounds distances to millimetres, so ties are equal on both sides
    away = F.round(distance_m("lat", "lng", F.lit(32.0), F.lit(-68.0)), 3)
    return found(t).orderBy(away.asc_nulls_last(), "name_latin", "business_id").limit(20).select(
        "business_id", "name_latin")


@query("so_2_markers_topk", """
SELECT business_id, name_latin, label, round(lat, 6) AS lat, round(lng, 6) AS lng
FROM shown WHERE lat IS NOT NULL ORDER BY score DESC, business_id LIMIT 1000""", V, SHOWN)
def _(t):
    return rk.markers(shown(t))


@query("pl_9_search", """
SELECT f.business_id, f.score, c.categories, s.sources, e.evidence
FROM (SELECT * FROM found ORDER BY score DESC, name_latin, business_id LIMIT 20) f
LEFT JOIN (SELECT business_id, string_agg(slug, ' ' ORDER BY slug) AS categories
  FROM business_category GROUP BY 1) c USING (business_id)
LEFT JOIN (SELECT business_id, string_agg(source, ' ' ORDER BY source) AS sources FROM (
  SELECT business_id, source_id AS source FROM record UNION SELECT business_id, kind FROM link
    WHERE kind IN ('facebook', 'instagram', 'telegram')) u GROUP BY 1) s USING (business_id)
LEFT JOIN (SELECT business_id, string_agg(signal, ' ' ORDER BY weight DESC, signal) AS evidence
  FROM evidence GROUP BY 1) e USING (business_id)""", FOUND_VIEWS + " record link", FOUND)
def _(t):
    page = rk.search_page(found(t), "confidence", 1, 20)
    records = t("record").withColumn("fetched_at", F.col("fetched_at").cast("timestamp"))
    proof = t("evidence").withColumn("url", F.lit(None).cast("string"))
    df = search.cards(page, t("business_category"), records, t("link"), proof)
    return df.select(
        "business_id", "score", F.array_join("categories", " ").alias("categories"),
        F.array_join(F.transform("sources", lambda s: s["source"]), " ").alias("sources"),
        F.array_join(F.transform("evidence", lambda e: e["signal"]), " ").alias("evidence"))


@query("jn_17_card_assembly", """
SELECT b.business_id, coalesce(c.n, 0) AS categories, coalesce(s.n, 0) AS sources,
  coalesce(e.n, 0) AS evidence
FROM business b
LEFT JOIN (SELECT business_id, count(*) AS n FROM business_category GROUP BY 1) c
  USING (business_id)
LEFT JOIN (SELECT business_id, count(*) AS n FROM (SELECT business_id, source_id FROM record
  UNION SELECT business_id, kind FROM link WHERE kind IN ('facebook', 'instagram', 'telegram')) u
  GROUP BY 1) s USING (business_id)
LEFT JOIN (SELECT business_id, count(*) AS n FROM evidence GROUP BY 1) e USING (business_id)
""", "business business_category record link evidence")
def _(t):
    records = t("record").withColumn("fetched_at", F.col("fetched_at").cast("timestamp"))
    proof = t("evidence").withColumn("url", F.lit(None).cast("string"))
    df = search.cards(t("business"), t("business_category"), records, t("link"), proof)

    def n(c):
        return F.coalesce(F.size(F.coalesce(c, F.array())), F.lit(0)).cast("long").alias(c)

    return df.select("business_id", n("categories"), n("sources"), n("evidence"))


@query("fn_30_map_urls", """
SELECT business_id, 'https://www.google.com/maps/search/?api=1&query='
  || replace(name_latin || ', ' || address, ' ', '%20').replace(',', '%2C') AS google_maps
FROM business""", "business")
def _(t):
    links = map_urls("name_latin", "address", "lat", "lng")
    return t("business").select("business_id", links["google_maps"].alias("google_maps"))


@query("pf_7_name_filter", """
SELECT business_id FROM business WHERE lower(name_latin) LIKE '%shop 01%'
  OR lower(address) LIKE '%shop 01%'""", "business")
def _(t):
    return fl.name_filter(t("business"), "SHOP 01", ["name_latin", "name_fa", "address"]).select(
        "business_id")


@query("fn_31_localized_label", """
SELECT signal AS code, coalesce(CASE signal WHEN 'AF' THEN 'Accepted, filled'
  WHEN 'NO' THEN 'New, open' END, signal) AS label, count(*) AS n FROM evidence GROUP BY 1, 2""",
       "evidence")
def _(t):
    from pyspark.sql import Row

    spark = t("evidence").sparkSession
    labels = spark.createDataFrame([Row(code="AF", label="Accepted, filled"),
                                    Row(code="NO", label="New, open")])
    counted = t("evidence").groupBy(F.col("signal").alias("code")).agg(
        F.count(F.lit(1)).alias("n"))
    return search.localized("code", counted, labels)


@query("pl_16_upsert_labels", """
SELECT coalesce(n.business_id, o.business_id) AS business_id,
  coalesce(n.verdict, o.verdict) AS verdict, coalesce(n.labeled_by, o.labeled_by) AS labeled_by,
  CASE WHEN n.business_id IS NOT NULL THEN s.score ELSE o.score_at_label END AS score_at_label
FROM (SELECT business_id, verdict, labeled_by, 0.5 AS score_at_label FROM label) o
FULL JOIN (SELECT l_orderkey AS business_id, arg_max(l_linestatus = 'F',
    CAST(l_shipdate AS VARCHAR) || lpad(CAST(l_partkey AS VARCHAR), 12, '0')
      || lpad(CAST(l_suppkey AS VARCHAR), 12, '0')) AS verdict, 'line' AS labeled_by
  FROM lineitem WHERE l_orderkey % 2 = 0 GROUP BY 1) n ON n.business_id = o.business_id
LEFT JOIN scored s ON s.business_id = n.business_id
WHERE n.business_id IS NULL OR s.business_id IS NOT NULL OR o.business_id IS NOT NULL""",
       "business evidence label", SCORED)
def _(t):
    old = t("label").select("business_id", "verdict", "labeled_by", "labeled_at",
                            F.lit(0.5).alias("score_at_label"))
    fresh = t("lineitem").where(F.col("l_orderkey") % 2 == 0).select(
        F.col("l_orderkey").alias("business_id"), F.col("l_shipdate").alias("labeled_at"),
        F.struct("l_partkey", "l_suppkey").alias("verdict_id"),
        (F.col("l_linestatus") == "F").alias("verdict"), F.lit("line").alias("labeled_by"))
    return moderation.upsert_labels(old, fresh, scored(t)).drop("labeled_at")
