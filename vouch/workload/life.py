"""Lifecycle, moderation, usage and streaming queries over events, orders and lineitem."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vouch.operators import analytics as an
from vouch.operators import ranking as rk
from vouch.operators import upsert as up
from vouch.operators.lineage import shared_folder
from vouch.plans import index, moderation, schedule
from vouch.streaming import jobs
from vouch.workload.views import QUERIES, query

SECRET = "salt"


def scratch(spark: SparkSession) -> str:
    """A new folder in the cluster's shared checkpoint folder (a local one in tests)."""
    return f"{shared_folder(spark).rstrip('/')}/{uuid.uuid4().hex}"


@query("ag_17_overview_counts", """
SELECT count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'approved')
  AS approved, count(*) FILTER (status = 'rejected' AND city_id < 5) AS rejected_there
FROM submission""", "submission")
def _(t):
    s = F.col("status")
    return an.count_where(t("submission"), pending=s == "pending", approved=s == "approved",
                          rejected_there=(s == "rejected") & (F.col("city_id") < 5))


def runs(t) -> DataFrame:
    """City -> source -> statistics of its last run, from the orders of the city."""
    rows = t("orders").groupBy(
        F.concat(F.lit("city"), (F.col("o_custkey") % 25).cast("string")).alias("city"),
        F.lower(F.substring("o_orderpriority", 3, 20)).alias("source")).agg(
        F.count(F.lit(1)).alias("seen"), F.count_if(F.col("o_totalprice") > 498000).alias("bad"))
    stats = F.struct("seen", F.when(F.col("bad") > 2, F.lit("unavailable")).alias("error"))
    return rows.groupBy("city").agg(F.map_from_entries(F.array_sort(F.collect_list(
        F.struct("source", stats.alias("stats"))))).alias("per_source"))


RUNS = """
runs AS (SELECT 'city' || CAST(o_custkey % 25 AS VARCHAR) AS city,
  lower(substr(o_orderpriority, 3)) AS source_id, count(*) AS seen,
  count(*) FILTER (o_totalprice > 498000) AS bad FROM orders GROUP BY 1, 2)"""


@query("ag_17_failed_sources", "SELECT city AS city_id, source_id, 'unavailable' AS error FROM runs "
       "WHERE bad > 2", "", RUNS)
def _(t):
    return an.failed_sources(runs(t).withColumnRenamed("city", "city_id"))


@query("ag_17_city_overview", """
SELECT city AS slug, CAST(sum(seen) AS BIGINT) AS shown, string_agg(source_id, ',' ORDER BY source_id)
  FILTER (bad > 2) AS failed FROM runs GROUP BY 1""", "", RUNS)
def _(t):
    status = runs(t).withColumnsRenamed({"city": "slug"}).withColumn("city_id", F.col("slug"))
    status = status.withColumn("category_counts", F.transform_values(
        "per_source", lambda k, v: v["seen"])).withColumn("last_indexed_at", F.lit(None))
    cities = status.select("city_id", "slug", F.lit("X").alias("country_code"))
    df = schedule.city_overview(cities, status.drop("slug"))
    names = F.array_join(F.array_sort(F.map_keys("failed")), ",")
    return df.select("slug", "shown", F.nullif(names, F.lit("")).alias("failed"))


@query("ag_24_source_runs", """
SELECT source_id, string_agg(city || '=' || CAST(seen AS VARCHAR), ',' ORDER BY city) AS last_runs
FROM runs GROUP BY 1""", "", RUNS)
def _(t):
    df = an.source_runs(runs(t))
    pairs = F.transform(F.array_sort(F.map_keys("last_runs")), lambda c: F.concat_ws(
        "=", c, F.col("last_runs")[c]["seen"].cast("string")))
    return df.select("source_id", F.array_join(pairs, ",").alias("last_runs"))


@query("ag_18_reports_per_entity", """
SELECT business_id, count(*) AS reports, count(*) >= 20 AS hide FROM report
WHERE reason = 'not_relevant' GROUP BY 1""", "report")
def _(t):
    return an.reports_per_entity(t("report"), "not_relevant", cut=20)


@query("ag_19_daily_client_count", f"""
SELECT day, sha256('{SECRET}|' || day || '|' || CAST(user_id AS VARCHAR)) AS client_hash, n, n > 1
  AS over_cap
FROM (SELECT CAST(CAST(created_at AS DATE) AS VARCHAR) AS day, user_id, count(*) AS n
  FROM submission GROUP BY 1, 2) t""", "submission")
def _(t):
    out = an.daily_clients(t("submission"), "user_id", "created_at", SECRET, cap=1)
    return out.withColumn("day", F.col("day").cast("string"))


@query("ag_19_daily_rows", """
SELECT CAST(CAST(created_at AS DATE) AS VARCHAR) AS day, count(*) AS n, count(*) > 65 AS over_cap
FROM submission GROUP BY 1""", "submission")
def _(t):
    return an.daily_rows(t("submission"), "created_at", cap=65).withColumn(
        "day", F.col("day").cast("string"))


CAPS = {"click": 1500, "view": 10, "error": None}


@query("ag_20_monthly_quota", """
SELECT event_id, used, CASE source_id WHEN 'click' THEN used <= 1500 WHEN 'view' THEN used <= 10
  ELSE true END AS admitted
FROM (SELECT event_id, event_type AS source_id, CASE WHEN event_type IN ('click', 'view') THEN
  row_number() OVER (PARTITION BY event_type, strftime(ts, '%Y-%m') ORDER BY ts, event_id) END
  AS used FROM events) t""")
def _(t):
    caps = t("events").select(F.col("event_type").alias("source_id")).distinct().withColumn(
        "monthly_cap", F.when(F.col("source_id") == "click", 1500)
        .when(F.col("source_id") == "view", 10))
    rows = t("events").select("event_id", F.col("event_type").alias("source_id"), "ts")
    return an.monthly_quota(rows, caps, order=["ts", "event_id"]).select(
        "event_id", "used", "admitted")


@query("so_3_most_reported", """
SELECT business_id, count(*) AS reports FROM report WHERE status = 'open' GROUP BY 1""", "report")
def _(t):
    return rk.most_reported(t("report").where("status = 'open'")).select("business_id", "reports")


@query("so_4_recent_jobs", """
SELECT event_id AS job_id, event_type AS kind FROM events WHERE ts >= TIMESTAMP '2024-01-24'
ORDER BY ts DESC, event_id DESC LIMIT 50""")
def _(t):
    rows = t("events").select(F.col("event_id").alias("job_id"), F.col("event_type").alias("kind"),
                              F.col("ts").cast("timestamp").alias("created_at"))
    since = F.lit("2024-01-24").cast("timestamp")
    return rk.recent_jobs(rows, since).select("job_id", "kind")


@query("jn_18_possible_duplicate", """
SELECT s.submission_id, min(e.business_id) AS business_id FROM submission s
JOIN entity_link y ON y.value = 'site' || CAST(s.user_id % 37 AS VARCHAR) || '.example.com'
JOIN entity e ON e.business_id = y.business_id AND e.city_id = s.city_id GROUP BY 1""",
       "submission entity entity_link")
def _(t):
    return moderation.possible_duplicates(submissions(t), t("entity"), t("entity_link")).select(
        "submission_id", "business_id")


def submissions(t) -> DataFrame:
    none = F.lit(None).cast("string")
    return t("submission").select(
        "submission_id", "city_id", "status", "name", "created_at", F.lit("CA").alias("country_code"),
        F.lit("other").alias("category"), none.alias("address"), none.alias("phone"),
        F.array("link").alias("links"), (F.col("user_id") % 2 == 0).alias("is_owner"))


@query("jn_20_review_queue", """
SELECT s.submission_id, c.name_en AS city_name, d.business_id FROM submission s
LEFT JOIN city c USING (city_id) LEFT JOIN (SELECT s.submission_id, min(e.business_id) AS business_id
  FROM submission s JOIN entity_link y
    ON y.value = 'site' || CAST(s.user_id % 37 AS VARCHAR) || '.example.com'
  JOIN entity e ON e.business_id = y.business_id AND e.city_id = s.city_id GROUP BY 1) d
  USING (submission_id) WHERE s.status = 'pending'""", "submission entity entity_link city")
def _(t):
    subs = submissions(t).withColumn("business_id", F.lit(None).cast("string"))
    dup = moderation.possible_duplicates(submissions(t), t("entity"), t("entity_link"))
    names = t("region").select(F.lower("r_name").alias("slug"), F.col("r_name").alias("name_en"))
    queue = moderation.review_queue(subs, "pending", t("city"), names, t("entity").select(
        "business_id", "name_latin"), dup)
    return queue.select("submission_id", "city_name", "business_id")


DECIDED = """
decisions AS (SELECT event_id AS decision_id, user_id % 97 AS business_id, ts AS decided_at,
  CASE event_id % 7 WHEN 0 THEN 'hide' WHEN 1 THEN 'close' WHEN 2 THEN 'restore' WHEN 3 THEN 'remove'
    ELSE 'dismiss' END AS action FROM events WHERE event_type = 'purchase' AND event_id % 5 = 0),
lastd AS (SELECT business_id, arg_max(action, (decided_at, decision_id)) AS action FROM decisions
  GROUP BY 1),
acting AS (SELECT business_id, arg_max(action, (decided_at, decision_id)) AS action FROM decisions
  WHERE action <> 'dismiss' GROUP BY 1)"""


def decisions(t) -> DataFrame:
    seven = F.col("event_id") % 7
    action = (F.when(seven == 0, "hide").when(seven == 1, "close").when(seven == 2, "restore")
              .when(seven == 3, "remove").otherwise("dismiss"))
    return t("events").where((F.col("event_type") == "purchase") & (F.col("event_id") % 5 == 0)
                             ).select(F.col("event_id").alias("decision_id"),
                                      (F.col("user_id") % 97).alias("business_id"),
                                      F.col("ts").alias("decided_at"), action.alias("action"))


def decided(t) -> dict[str, DataFrame]:
    block = t("link").where(F.col("business_id") % 10 == 0).select("kind", "value").distinct()
    return moderation.apply_decisions(t("business"), t("report"), t("link"), block, decisions(t))


@query("pl_12_apply_decisions", """
SELECT b.business_id, coalesce(CASE a.action WHEN 'hide' THEN 'hidden' WHEN 'close' THEN 'closed'
  WHEN 'restore' THEN 'active' WHEN 'remove' THEN 'removed_by_request' END, b.status) AS status
FROM business b LEFT JOIN acting a USING (business_id)""", "business", DECIDED)
def _(t):
    return decided(t)["entities"].select("business_id", "status")


@query("pl_12_close_reports", """
SELECT r.report_id, CASE WHEN r.status = 'open' AND d.action IS NOT NULL THEN CASE d.action
  WHEN 'dismiss' THEN 'dismissed' ELSE 'resolved' END ELSE r.status END AS status
FROM report r LEFT JOIN lastd d USING (business_id)""", "report", DECIDED)
def _(t):
    return decided(t)["reports"].select("report_id", "status")


@query("st_4_new_block_entries", """
SELECT DISTINCT kind, value FROM link WHERE business_id IN (SELECT business_id FROM decisions
  WHERE action = 'remove') AND (kind, value) NOT IN (SELECT (kind, value) FROM link
  WHERE business_id % 10 = 0)""", "link", DECIDED)
def _(t):
    removed = decisions(t).where("action = 'remove'").select("business_id").distinct()
    block = t("link").where(F.col("business_id") % 10 == 0).select("kind", "value").distinct()
    return up.new_block_entries(removed, t("link"), block)


@query("pl_13_apply_owner_edits", """
SELECT b.business_id, coalesce(e.name, b.name_latin) AS name_latin, coalesce(e.status, b.status)
  AS status FROM business b LEFT JOIN (SELECT user_id AS business_id,
    arg_max(CASE WHEN event_id % 3 = 0 THEN 'Owner ' || CAST(event_id AS VARCHAR) END, (ts, event_id))
      FILTER (event_id % 3 = 0) AS name,
    arg_max('closed', (ts, event_id)) FILTER (event_id % 5 = 0) AS status
  FROM events WHERE event_type = 'view' AND event_id % 11 <> 0 GROUP BY 1) e USING (business_id)
""", "business")
def _(t):
    e = F.col("event_id")
    none = F.lit(None).cast("string")
    edits = t("events").where("event_type = 'view'").select(
        e.alias("edit_id"), F.col("user_id").alias("business_id"), F.col("ts").alias("edited_at"),
        F.lit("CA").alias("country_code"), none.alias("name_fa"),
        F.when(e % 3 == 0, F.concat(F.lit(" Owner "), e.cast("string"))).otherwise(" ")
        .alias("name_latin"), none.alias("address"),
        F.when(e % 11 == 0, "not a phone").alias("phone"), none.alias("website"),
        F.when(e % 5 == 0, "closed").alias("status"))
    rows = t("business").withColumns({"phone_e164": none, "website": none})
    return moderation.apply_owner_edits(rows, edits)["entities"].select(
        "business_id", "name_latin", "status")


CUT = "TIMESTAMP '1998-01-01'"


@query("st_1_missing_records", f"""
SELECT source_id, external_id FROM record r WHERE fetched_at < {CUT} AND source_id <> 'src3'
  AND NOT EXISTS (SELECT 1 FROM record s WHERE s.fetched_at >= {CUT} AND s.source_id <> 'src3'
    AND s.source_id = r.source_id AND s.business_id = r.business_id)""", "record")
def _(t):
    # known before, seen after; the last source returned nothing and is not trusted
    cut = F.lit("1998-01-01").cast("timestamp_ntz")
    known = t("record").where(F.col("fetched_at") < cut)
    later = t("record").where((F.col("fetched_at") >= cut) & (F.col("source_id") != "src3"))
    seen = known.join(later.select("source_id", "business_id"), ["source_id", "business_id"],
                      "left_semi").select("source_id", "external_id")
    seen = seen.unionByName(later.select("source_id", "external_id"))
    return up.missing_records(known, seen, ["source_id"])


@query("pl_5_prune", f"""
SELECT b.business_id FROM business b WHERE EXISTS (SELECT 1 FROM record r
  WHERE r.business_id = b.business_id AND fetched_at >= {CUT})""", "business record")
def _(t):
    missing = t("record").where(F.col("fetched_at") < F.lit("1998-01-01").cast("timestamp_ntz"))
    links = t("link").select("business_id", "kind", "value")
    out = up.prune(t("business"), t("record"), t("evidence"), links, t("business_category"), missing)
    return out["entities"].select("business_id")


@query("pl_4_stale_record", f"""
SELECT r.source_id, r.external_id, r.business_id, coalesce(e.n, 0) AS evidence,
  coalesce(e.again, 0) AS again
FROM record r LEFT JOIN (SELECT v.source_id, v.external_id,
    count(*) FILTER (o.fetched_at >= {CUT} OR v.weight > 0.2) AS n,
    count(*) FILTER (o.fetched_at < {CUT} AND v.weight > 0.2) AS again
  FROM evidence v JOIN record o USING (source_id, external_id) GROUP BY 1, 2) e
  USING (source_id, external_id)""", "record evidence")
def _(t):
    # stale records were read again: their stronger signals were found anew, the others were not
    stale = t("record").where(F.col("fetched_at") < F.lit("1998-01-01").cast("timestamp_ntz"))
    key = ["source_id", "external_id"]
    fresh = t("evidence").where("weight > 0.2").join(stale.select(*key), key).withColumn(
        "snippet", F.lit("again"))
    left = up.replace_evidence(t("evidence"), stale, fresh)
    n = left.groupBy(*key).agg(F.count(F.lit(1)).alias("evidence"),
                               F.count_if(F.col("snippet") == "again").alias("again"))
    return t("record").select(*key, "business_id").join(n, key, "left").na.fill(
        0, ["evidence", "again"])


@query("pl_3_merge_entity", """
SELECT business_id, slug FROM (SELECT business_id, slug, bool_or(slug <> 'other')
  OVER (PARTITION BY business_id) AS real FROM (SELECT business_id, slug FROM business_category
  UNION SELECT business_id, CASE WHEN weight > 0.5 THEN 'strong' ELSE 'other' END FROM evidence) u) t
WHERE slug <> 'other' OR NOT real""", "business_category evidence")
def _(t):
    fresh = t("evidence").select("business_id", F.when(F.col("weight") > 0.5, "strong")
                                 .otherwise("other").alias("slug"))
    return up.add_categories(t("business_category"), fresh)


@query("pl_3_add_links", """
SELECT business_id, kind, value, min(url) AS url FROM (SELECT business_id, kind, value, url, 0 AS p
    FROM link WHERE link_id % 2 = 0
  UNION ALL SELECT f.business_id, f.kind, f.value, 'x' || f.url, 1 FROM link f WHERE NOT EXISTS (
    SELECT 1 FROM link o WHERE o.link_id % 2 = 0 AND o.business_id = f.business_id
      AND o.kind = f.kind AND o.value = f.value)) t GROUP BY 1, 2, 3""", "link")
def _(t):
    cols = ["business_id", "kind", "value", "url"]
    old = t("link").where(F.col("link_id") % 2 == 0).select(*cols)
    fresh = t("link").withColumn("url", F.concat(F.lit("x"), "url")).select(*cols)
    return up.add_links(old, fresh)


@query("pl_7_refresh_candidates", """
SELECT b.business_id, min_by(l.url, (l.value, l.url)) AS url FROM business b JOIN link l
  ON l.business_id = b.business_id AND l.kind = 'website'
WHERE b.status = 'active' AND b.business_id % 7 <> 0 AND (b.verified IS NULL
  OR NOT b.verified >= TIMESTAMP '2001-08-01' - INTERVAL 30 DAYS) GROUP BY 1""", "business link")
def _(t):
    score = F.when(F.col("business_id") % 7 == 0, 0.1).otherwise(0.15)
    tables = index.Tables(t("business").withColumn("score", score), t("record"), t("evidence"),
                          t("link"), t("business_category"))
    checked = t("business").select("business_id", F.col("verified").cast("timestamp")
                                   .alias("checked_at"))
    out = index.refresh_candidates(tables, "website", checked, "2001-08-01 00:00:00")
    return out.select("business_id", "url")


@query("pl_11_approved_listings", """
SELECT CAST(submission_id AS VARCHAR) AS external_id, name, 0.8e0 AS weight FROM submission
WHERE status = 'approved'""", "submission")
def _(t):
    rows = moderation.submission_listings(submissions(t).where("status = 'approved'"))
    return rows.select("external_id", "name", F.get("signals", F.lit(0))["weight"].alias("weight"))


@query("pl_8_channel_outcomes", """
SELECT CASE WHEN user_id % 5 = 0 THEN 'retry_later' WHEN event_type = 'error' THEN 'not_found'
  WHEN value > 5 THEN 'with_evidence' ELSE 'no_evidence' END AS outcome, count(*) AS n
FROM events GROUP BY 1""")
def _(t):
    rows = t("events").select(
        (F.col("user_id") % 5 == 0).alias("retryable"), F.lit(True).alias("ok"),
        (F.col("event_type") != "error").alias("exists"), (F.col("value") > 5).cast("int")
        .alias("signals"))
    return an.channel_outcomes(rows)


# ---- streaming: the batch equivalent is the check ---------------------------------------


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return (spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet")
            .option("maxFilesPerTrigger", 1).parquet(sf_dir))


def drain(stream: DataFrame, mode: str, key: list[str] | None = None) -> DataFrame:
    """Run a stream over what is there and return the written table. In append mode rows are
    written once. In update mode every batch writes the rows that it changed, in a folder of its
    own that a replay overwrites, and the newest row of each ``key`` counts."""
    spark = stream.sparkSession
    root = scratch(spark)
    if mode == "append":
        writer = stream.writeStream.format("parquet").option("path", f"{root}/out")
    else:
        writer = stream.writeStream.foreachBatch(
            lambda df, i: df.write.mode("overwrite").parquet(f"{root}/out/batch={i}"))
    run = (writer.outputMode(mode).option("checkpointLocation", f"{root}/state")
           .trigger(availableNow=True).start())
    run.awaitTermination()
    if mode == "append":
        return spark.read.schema(stream.schema).parquet(f"{root}/out")
    fields = T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])
    written = spark.read.schema(fields).parquet(f"{root}/out")
    rest = [c for c in stream.columns if c not in key]
    newest = written.groupBy(*key).agg(F.max_by(F.struct(*rest), "batch").alias("_r"))
    return newest.select(*key, "_r.*").select(*stream.columns)


def streaming(name: str, sql: str, views: str = ""):
    def register(fn):
        query(name, sql, views)(lambda t: None)
        QUERIES[name] = fn
        return fn

    return register


@streaming("ss_2_report_threshold", """
SELECT user_id % 97 AS business_id, count(*) AS reports, count(*) >= 20 AS hide FROM events
WHERE event_type = 'error' GROUP BY 1""")
def _(spark, sf_dir):
    stream = event_stream(spark, sf_dir).select(
        (F.col("user_id") % 97).alias("business_id"), F.col("event_type").alias("reason"))
    return drain(jobs.report_counts(stream, "error", cut=20), "update", ["business_id"])


@streaming("ss_3_usage_days", """
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, user_id, count(*) AS n, count(*) > 5 AS over_cap
FROM events GROUP BY 1, 2""")
def _(spark, sf_dir):
    days = jobs.usage_days(event_stream(spark, sf_dir), "user_id", "ts", cap=5, delay=None)
    return drain(days, "update", ["day", "user_id"]).withColumn("day", F.col("day").cast("string"))


@streaming("ss_3_usage_months", """
SELECT event_type, strftime(ts, '%Y-%m') AS period, count(*) AS used, CASE event_type
  WHEN 'click' THEN count(*) > 1500 WHEN 'view' THEN count(*) > 10 ELSE false END AS over_cap
FROM events GROUP BY 1, 2""")
def _(spark, sf_dir):
    caps = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type").distinct().select(
        "event_type", F.when(F.col("event_type") == "click", 1500)
        .when(F.col("event_type") == "view", 10).alias("monthly_cap"))
    days = jobs.usage_days(event_stream(spark, sf_dir), "event_type", "ts", delay=None)
    days = drain(days, "update", ["day", "event_type"])
    return jobs.usage_months(days, "event_type", caps).select("event_type", "period", "used",
                                                              "over_cap")


@streaming("ss_4_recheck_due", """
SELECT user_id, CAST(CAST(last AS DATE) AS VARCHAR) AS day FROM (SELECT user_id,
    max(ts) FILTER (event_type <> 'error') AS last FROM events GROUP BY 1) t
WHERE last IS NULL OR last + INTERVAL 1 DAY < (SELECT max(ts) FROM events)""")
def _(spark, sf_dir):
    checks = event_stream(spark, sf_dir).select(
        "user_id", F.col("ts").alias("checked_at"), (F.col("event_type") == "error")
        .alias("retryable"))
    out = drain(jobs.recheck_timer(checks, "user_id", days=1), "append")
    return out.select("user_id", F.to_date("last_checked").cast("string").alias("day"))


@streaming("ss_1_listing_ingest", """
SELECT event_type AS source_id, CAST(user_id AS VARCHAR) AS external_id, 1 AS n FROM events
GROUP BY 1, 2""")
def _(spark, sf_dir):
    listings = event_stream(spark, sf_dir).select(
        F.col("event_type").alias("source_id"), F.col("user_id").cast("string")
        .alias("external_id"), F.col("ts").alias("fetched_at"))
    once = drain(jobs.fresh_listings(listings, delay="60 days"), "append")
    return once.groupBy("source_id", "external_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
