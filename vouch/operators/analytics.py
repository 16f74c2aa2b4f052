"""Counts, coverage, precision and usage reports."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vouch import fixed_values as fv
from vouch.functions.scoring import confidence_label, damped, settle, wilson
from vouch.operators.ranking import ranked


def category_counts(shown: DataFrame, categories: DataFrame) -> DataFrame:
    """(city_id, slug, n) of shown entities; an entity counts once per category."""
    pairs = shown.select("business_id", "city_id").join(categories, "business_id")
    return pairs.groupBy("city_id", "slug").agg(F.count(F.lit(1)).alias("n"))


def top_category_counts(shown: DataFrame, entity_categories: DataFrame, categories: DataFrame,
                        cities: DataFrame) -> DataFrame:
    """(city_id, slug of the parent category, n distinct entities), long form."""
    parents = categories.select("slug", F.coalesce("parent_slug", "slug").alias("top"))
    pairs = (shown.select("business_id", "city_id").join(entity_categories, "business_id")
             .join(parents, "slug", "left")
             .select("city_id", "business_id", F.coalesce("top", "slug").alias("slug")))
    counts = pairs.groupBy("city_id", "slug").agg(F.count_distinct("business_id").alias("n"))
    return cities.select("city_id").join(counts, "city_id", "left")


def count_map(counts: DataFrame, key: str, name: str, value: str, out: str) -> DataFrame:
    """Fold (key, name, value) rows into one map per key, empty where there is no name."""
    entry = F.when(F.col(name).isNotNull(), F.struct(F.col(name), F.col(value)))
    return counts.groupBy(key).agg(F.map_from_entries(
        F.array_sort(F.collect_list(entry))).alias(out))


def source_counts(shown: DataFrame, records: DataFrame) -> DataFrame:
    """(city_id, source_id, n): distinct shown entities per source of their records."""
    pairs = shown.select("business_id", "city_id").join(
        records.select("business_id", "source_id"), "business_id")
    return pairs.groupBy("city_id", "source_id").agg(F.count_distinct("business_id").alias("n"))


def social_counts(shown: DataFrame, links: DataFrame,
                  kinds: tuple[str, ...] = fv.SOCIAL_KINDS) -> DataFrame:
    """(city_id, kind, n): distinct shown entities per social link kind."""
    pairs = shown.select("business_id", "city_id").join(
        links.where(F.col("kind").isin(*kinds)).select("business_id", "kind"), "business_id")
    return pairs.groupBy("city_id", "kind").agg(F.count_distinct("business_id").alias("n"))


def multi_source(shown: DataFrame, records: DataFrame, at_least: int = 2) -> DataFrame:
    """(city_id, n): shown entities backed by several distinct record sources."""
    several = records.groupBy("business_id").agg(
        F.count_distinct("source_id").alias("sources")).where(F.col("sources") >= at_least)
    joined = shown.select("business_id", "city_id").join(several, "business_id")
    return joined.groupBy("city_id").agg(F.count(F.lit(1)).alias("n"))


def coverage(cities: DataFrame, shown: DataFrame, records: DataFrame,
             links: DataFrame) -> DataFrame:
    """Per city: shown, map of counts per source and social kind, independent sources and
    entities with several sources. Cities without entities are kept."""
    by_source = source_counts(shown, records)
    by_kind = social_counts(shown, links)
    named = by_source.withColumnRenamed("source_id", "name").unionByName(
        by_kind.withColumnRenamed("kind", "name"))
    maps = count_map(named, "city_id", "name", "n", "sources")
    independent = by_source.groupBy("city_id").agg(F.count(F.lit(1)).alias("source_count"))
    totals = shown.groupBy("city_id").agg(F.count(F.lit(1)).alias("shown"))
    multi = multi_source(shown, records).withColumnRenamed("n", "multi_source")
    out = cities.select("city_id", F.col("slug").alias("city"))
    for part in (totals, maps, independent, multi):
        out = out.join(part, "city_id", "left")
    zero = F.lit(0).cast("long")
    return out.select(
        "city", F.coalesce("shown", zero).alias("shown"),
        F.coalesce("sources", F.map_from_arrays(F.array().cast("array<string>"),
                                                F.array().cast("array<bigint>"))).alias("sources"),
        F.coalesce("source_count", zero).alias("source_count"),
        F.coalesce("multi_source", zero).alias("multi_source"))


def coverage_table(report: DataFrame, names: list[str]) -> DataFrame:
    """Coverage as a wide table, one column per source, missing counts as 0."""
    cells = [F.coalesce(F.try_element_at("sources", F.lit(n)), F.lit(0).cast("long")).alias(n)
             for n in names]
    return report.select("city", "shown", *cells, "source_count", "multi_source")


def pivot_counts(counts: DataFrame, key: str, name: str, value: str,
                 names: list[str] | None = None) -> DataFrame:
    """Long counts to one column per name. Pass the names to save the extra pass."""
    return counts.groupBy(key).pivot(name, names).agg(F.first(value)).na.fill(0)


def shared_links(entry_links: DataFrame, entry: str, value: str = "value",
                 limit: int = fv.SHARED_LINK_LIMIT) -> DataFrame:
    """Link values that more than ``limit`` entries carry; an entry counts once."""
    once = entry_links.select(entry, value).distinct()
    return once.groupBy(value).agg(F.count(F.lit(1)).alias("entries")).where(
        F.col("entries") > limit)


def drop_shared_links(entry_links: DataFrame, entry: str, value: str = "value",
                      limit: int = fv.SHARED_LINK_LIMIT) -> DataFrame:
    return entry_links.join(shared_links(entry_links, entry, value, limit).select(value), value,
                            "left_anti")


def _levels(df: DataFrame) -> DataFrame:
    """The three-row level dimension, derived without collecting anything."""
    spark = df.sparkSession
    rows = [(name, i) for i, name in enumerate(fv.LEVEL_CUTS)]
    return spark.createDataFrame(rows, "level string, position int")


def precision_by_level(labelled: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Per level (and ``by``): labelled, hits, precision, Wilson interval. ``labelled`` has
    level and verdict; levels without labels are kept."""
    by = by or []
    counted = labelled.groupBy(*by, "level").agg(
        F.count(F.lit(1)).alias("labeled"), F.count_if("verdict").alias("hits"))
    frame = _levels(labelled)
    if by:
        # level dimension per group: three rows for each distinct group
        groups = labelled.select(*by).distinct()
        levels = F.array(*[F.struct(F.lit(n).alias("level"), F.lit(i).alias("position"))
                           for i, n in enumerate(fv.LEVEL_CUTS)])
        frame = groups.select(*by, F.inline(levels))
    out = frame.join(counted, [*by, "level"], "left").withColumns({
        "labeled": F.coalesce("labeled", F.lit(0)), "hits": F.coalesce("hits", F.lit(0))})
    low, high = wilson("hits", "labeled")
    return out.select(
        *by, "level", "labeled", "hits",
        F.when(F.col("labeled") > 0, settle(F.col("hits") / F.col("labeled"), 3))
        .alias("precision"),
        settle(low, 3).alias("ci_low"), settle(high, 3).alias("ci_high"))


def precision_overall(labelled: DataFrame, goal: float = fv.PRECISION_GOAL) -> DataFrame:
    """One row: labels and hits of high and medium together, their share, goal reached."""
    counted = labelled.where(F.col("level").isin("high", "medium")).agg(
        F.count(F.lit(1)).alias("labeled"), F.count_if("verdict").alias("hits"))
    share = F.when(F.col("labeled") > 0, F.col("hits") / F.col("labeled"))
    return counted.select(
        "labeled", "hits", settle(share, 3).alias("high_and_medium"), F.lit(goal).alias("goal"),
        F.coalesce(share >= goal, F.lit(False)).alias("met"),
        F.lit(fv.LABELS_PER_LEVEL).alias("target_per_level"))


def what_if(evidence: DataFrame, labels: DataFrame, scenarios: Mapping[str, Mapping[str, float]],
            negative: Column | None = None, key: str = "business_id") -> DataFrame:
    """Precision by level if some signal weights changed, for many scenarios in one job.

    ``scenarios``: name -> {signal: weight}. Evidence is first reduced to the strongest row
    per labelled entity and signal (a changed weight replaces every weight of its signal, so
    the strongest row is enough). One aggregation per entity then gives the products of all
    scenarios side by side; only the scored labels are repeated per scenario.
    """
    if negative is None:
        negative = F.col("signal") == fv.NEGATIVE_SIGNAL
    labels = labels.select(key, "verdict")
    reduced = evidence.where(F.col("signal").isNotNull()).join(labels.select(key), key, "left_semi").groupBy(
        key, "signal").agg(F.max("weight").alias("weight")).withColumn("_neg", negative)

    def product(changes: Mapping[str, float]) -> Column:
        weight = F.col("weight")
        for signal, value in changes.items():
            weight = F.when(F.col("signal") == signal, F.lit(value)).otherwise(weight)
        return F.product(F.when(~F.col("_neg"), 1 - weight))

    fused = reduced.groupBy(key).agg(F.max("_neg").alias("_n"), *[
        product(changes).alias(f"_p{i}") for i, changes in enumerate(scenarios.values())])
    scores = F.array(*[F.struct(F.lit(name).alias("scenario"), damped(F.col(f"_p{i}"), F.col("_n")).alias("score"))
                       for i, name in enumerate(scenarios)])
    levels = labels.join(fused, key, "left").select("verdict", F.inline(scores)).select(
        "scenario", "verdict",
        confidence_label(F.coalesce("score", F.lit(0.0))).alias("level"))
    return precision_by_level(levels, by=["scenario"])


def label_progress(labels: DataFrame, entities: DataFrame) -> DataFrame:
    """Labels per level with the rank of need (fewest labels first)."""
    counted = labels.select("business_id").join(
        entities.select("business_id", F.col("label").alias("level")), "business_id").groupBy(
        "level").agg(F.count(F.lit(1)).alias("labels"))
    out = _levels(labels).join(counted, "level", "left").withColumn(
        "labels", F.coalesce("labels", F.lit(0)))
    # the window runs over the three level rows only
    need = F.row_number().over(Window.orderBy("labels", "position"))
    return out.select("level", "labels", need.alias("need"))


def fetch_outcomes(outcomes: DataFrame) -> DataFrame:
    """(outcome, n). Input: ok, reason, signals (count). Failures count under the part of
    their reason before the colon."""
    name = F.when(F.col("ok"), F.when(F.col("signals") > 0, "with_evidence")
                  .otherwise("no_evidence")).otherwise(
        F.substring_index(F.coalesce(F.nullif("reason", F.lit("")), F.lit("error")), ":", 1))
    return outcomes.groupBy(name.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def channel_outcomes(outcomes: DataFrame) -> DataFrame:
    """(outcome, n) of channel previews: retryable, ok, exists and signals (count)."""
    name = (F.when(F.col("retryable"), "retry_later")
            .when(~F.col("ok") | ~F.col("exists"), "not_found")
            .when(F.col("signals") > 0, "with_evidence").otherwise("no_evidence"))
    return outcomes.groupBy(name.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def retryable(reason: Column, ok: Column) -> Column:
    """Network trouble rather than a final answer of the site."""
    return ~ok & F.coalesce(reason.rlike(r"^(?:error|http_5)") | (reason == "robots_unreachable"),
                            F.lit(False))


def run_stats(seen: DataFrame, removed: DataFrame, errors: DataFrame) -> DataFrame:
    """Per source: listings seen, stored, removed, and the error of a failed source.

    ``seen``: source_id, stored; ``removed``: source_id; ``errors``: source_id, error."""
    counted = seen.groupBy("source_id").agg(F.count(F.lit(1)).alias("seen"),
                                            F.count_if("stored").alias("stored"))
    gone = removed.groupBy("source_id").agg(F.count(F.lit(1)).alias("removed"))
    out = counted.join(gone, "source_id", "full").join(errors, "source_id", "full")
    return out.na.fill(0, ["seen", "stored", "removed"])


def country_city_counts(countries: DataFrame, cities: DataFrame) -> DataFrame:
    """Enabled countries with their number of cities, zero kept."""
    counted = cities.groupBy(F.col("country_code").alias("code")).agg(
        F.count(F.lit(1)).alias("city_count"))
    return countries.where("enabled").select("code", "name_en").join(
        counted, "code", "left").na.fill(0, ["city_count"])


def failed_sources(status: DataFrame) -> DataFrame:
    """(city_id, source_id, error) of the failed source runs of each city."""
    return status.select("city_id", F.explode("per_source").alias("source_id", "stats")).where(
        F.coalesce("stats.error", F.lit("")) != "").select(
        "city_id", "source_id", F.col("stats.error").alias("error"))


def count_where(df: DataFrame, **conditions: Column) -> DataFrame:
    """One row with a count per named condition."""
    return df.agg(*[F.count_if(c).alias(n) for n, c in conditions.items()])


def reports_per_entity(reports: DataFrame, reason: str,
                       cut: int = fv.HIDE_AFTER_REPORTS) -> DataFrame:
    """(business_id, reports, hide) for one reason; entities at the cut are to be hidden."""
    counted = reports.where(F.col("reason") == reason).groupBy("business_id").agg(
        F.count(F.lit(1)).alias("reports"))
    return counted.withColumn("hide", F.col("reports") >= cut)


def daily_clients(rows: DataFrame, client: str, ts: str, secret: str, cap: int) -> DataFrame:
    """(day, client_hash, n, over_cap). The salted hash hides the client and changes daily."""
    day = F.to_date(ts)
    hashed = F.sha2(F.concat_ws("|", F.lit(secret), day.cast("string"),
                                F.col(client).cast("string")), 256)
    counted = rows.where(F.col(client).isNotNull()).groupBy(
        day.alias("day"), hashed.alias("client_hash")).agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("over_cap", F.col("n") > cap)


def daily_rows(rows: DataFrame, ts: str, cap: int) -> DataFrame:
    """(day, n, over_cap) of rows per UTC day."""
    counted = rows.groupBy(F.to_date(ts).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("over_cap", F.col("n") > cap)


def monthly_quota(requests: DataFrame, caps: DataFrame, *, order: list[str],
                  ts: str = "ts") -> DataFrame:
    """Requests with their place in the month of their source and whether the cap admits them.

    ``requests``: source_id, ts; every request costs one, a refused one uses nothing. ``caps``:
    source_id, monthly_cap (null or absent: unlimited). Rows of uncapped sources skip the
    ordering, and the rank inside a month is built from day subtotals; days are numbered over
    range partitions, so no source or day is sorted in a single task.
    """
    period, day = F.date_format(ts, "yyyy-MM"), F.to_date(ts)
    df = requests.withColumn("period", period).withColumn("_day", day).join(
        caps.select("source_id", "monthly_cap"), "source_id", "left")
    free = df.where(F.col("monthly_cap").isNull()).withColumn(
        "used", F.lit(None).cast("long")).withColumn("admitted", F.lit(True))
    capped = df.where(F.col("monthly_cap").isNotNull())
    per_day = capped.groupBy("source_id", "period", "_day").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("source_id", "period").orderBy("_day").rowsBetween(
        Window.unboundedPreceding, -1))
    offsets = per_day.select("source_id", "period", "_day",
                             F.coalesce(before, F.lit(0)).alias("_before"))
    placed = ranked(capped, ["source_id", "period", "_day"], order).join(
        offsets, ["source_id", "period", "_day"])
    counted = placed.withColumn("used", F.col("_before") + F.col("position")).withColumn(
        "admitted", F.col("used") <= F.col("monthly_cap")).drop("position", "_before")
    return free.unionByName(counted).drop("_day")


def upstream_mix(listings: DataFrame, datasets: str) -> DataFrame:
    """(dataset, n): listings per contributing data set; a listing counts once for each."""
    return listings.select(F.explode(F.array_distinct(datasets)).alias("dataset")).groupBy(
        "dataset").agg(F.count(F.lit(1)).alias("n"))


def type_concat(types: DataFrame, key: str, label: str, sep: str = "|") -> DataFrame:
    """Distinct labels per item joined in sorted order."""
    once = types.select(key, label).where(F.col(label).isNotNull()).distinct()
    return once.groupBy(key).agg(F.array_join(
        F.array_sort(F.collect_list(label)), sep).alias("types"))


def source_runs(status: DataFrame) -> DataFrame:
    """Invert city -> source -> stats into (source_id, map city -> stats)."""
    rows = status.select("city", F.explode("per_source").alias("source_id", "stats"))
    return rows.groupBy("source_id").agg(F.map_from_entries(F.array_sort(
        F.collect_list(F.struct("city", "stats")))).alias("last_runs"))


def host_discovery(pages: DataFrame, languages: list[str], tlds: list[str]) -> DataFrame:
    """(host, pages) of pages in the wanted languages on hosts with a wanted ending."""
    from vouch.functions.links import url_parts

    df = pages.select(url_parts("url")["host"].alias("host"), "lang")
    tld = F.substring_index("host", ".", -1)
    return df.where(F.col("lang").isin(*languages) & tld.isin(*tlds)).groupBy("host").agg(
        F.count(F.lit(1)).alias("pages"))
