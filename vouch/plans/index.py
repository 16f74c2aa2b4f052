"""Building and refreshing the index: detect, block, resolve, merge, prune, score."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vouch import fixed_values as fv
from vouch import schemas
from vouch.functions.links import listing_links, website_link
from vouch.functions.signals import Lexicon
from vouch.functions.text import split_name
from vouch.operators import analytics, upsert
from vouch.operators.evidence import rescore, shown
from vouch.operators.filters import drop_blocked, drop_excluded_keywords
from vouch.operators.lineage import cut
from vouch.operators.ranking import first_link_per_entity, survivorship
from vouch.plans.resolve import order_key, resolve_entities
from vouch.sources.listing import KEY, detect
from vouch.sources.pages import channel_evidence, page_evidence


@dataclass(frozen=True)
class Tables:
    """The stored tables of the index."""

    entities: DataFrame
    records: DataFrame
    evidence: DataFrame
    links: DataFrame
    categories: DataFrame

    @staticmethod
    def empty(spark) -> Tables:
        make = lambda s: spark.createDataFrame([], s)
        return Tables(make(schemas.BUSINESS), make(schemas.SOURCE_RECORD),
                      make(schemas.EVIDENCE), make(schemas.BUSINESS_LINK),
                      make(schemas.BUSINESS_CATEGORY))

    @staticmethod
    def read(spark, path: str) -> Tables:
        return Tables(*[spark.read.parquet(f"{path}/{f.name}") for f in fields(Tables)])

    def write(self, path: str) -> None:
        """Write a new version to a folder of its own; readers switch when it is complete."""
        for f in fields(Tables):
            getattr(self, f.name).write.mode("overwrite").parquet(f"{path}/{f.name}")

    def settle(self) -> Tables:
        return Tables(*[cut(getattr(self, f.name)) for f in fields(Tables)])


def assign_city(listings: DataFrame, cities: DataFrame) -> DataFrame:
    """Listings with city_id and country_code. A city_id the source already knows stays (a
    city's own licence register, a wiki page); the others get the city whose box covers
    them, the smallest box first, and are dropped outside all boxes."""
    from vouch.operators.spatial import city_box_join

    if "city_id" not in listings.columns:
        listings = listings.withColumn("city_id", F.lit(None).cast("long"))
    dims = cities.select("city_id", "country_code")
    given = listings.where(F.col("city_id").isNotNull()).join(dims, "city_id")
    rest = listings.where(F.col("city_id").isNull()).drop("city_id")
    area = (F.col("east") - F.col("west")) * (F.col("north") - F.col("south"))
    boxes = cities.select("city_id", "country_code", "west", "south", "east", "north",
                          area.alias("_area"))
    pairs = city_box_join(rest.select(*KEY, "lat", "lng"), boxes)
    best = pairs.groupBy(*KEY).agg(
        F.min(F.struct("_area", "city_id", "country_code")).alias("_b"))
    boxed = rest.join(best.select(*KEY, "_b.city_id", "_b.country_code"), KEY)
    return given.unionByName(boxed)


def _last_of_key(listings: DataFrame) -> DataFrame:
    """One listing per key: of several, the one with the greatest hash of all its columns. A
    snapshot has no order of its rows, so this stands for "a later row replaces an earlier one"
    and gives the same listing in every run."""
    every = F.xxhash64(F.to_json(F.struct(*listings.columns)))
    best = listings.withColumn("_h", every)
    last = best.groupBy(*KEY).agg(F.max("_h").alias("_h"))
    return best.join(last, [*KEY, "_h"], "left_semi").drop("_h").dropDuplicates(KEY)


def merge_listings(tables: Tables, listings: DataFrame, block_list: DataFrame,
                   lexicon: Lexicon, at: str, *,
                   order: tuple[str, ...] = fv.SOURCE_ORDER) -> tuple[Tables, DataFrame]:
    """Merge listings (with city_id and country_code) into the tables.

    Returns the new tables and (key, city_id, stored) for every listing seen. A known record
    without positive evidence keeps its row and loses its evidence.
    """
    now = F.lit(at).cast("timestamp")
    seen = listings.select(*KEY, "city_id", "country_code")
    found = detect(listings, lexicon, country="country_code")
    found = found.withColumn("links", listing_links("urls", "phones", "country_code"))
    kept = cut(drop_blocked(found, block_list, KEY))
    resolved = resolve_entities(kept, tables.entities, tables.records, tables.links, order=order)
    rows = cut(kept.join(resolved, KEY).withColumn("_ord", order_key(order)))

    positive = found.select(*KEY)
    stale = tables.records.join(seen, KEY, "left_semi").join(positive, KEY, "left_anti")
    fresh = rows.select(*KEY, "business_id", F.col("url").alias("_url"),
                        F.explode("signals").alias("s")).select(
        *KEY, "business_id", "s.signal", "s.weight", "s.snippet",
        F.coalesce("s.url", "_url").alias("url"))
    touched = rows.select(*KEY).unionByName(stale.select(*KEY))
    records = upsert.upsert(
        tables.records,
        rows.select("source_id", "external_id", "business_id", "url", "raw",
                    now.alias("fetched_at")), KEY)
    links = upsert.add_links(tables.links, rows.select(
        "business_id", F.explode("links").alias("l")).select("business_id", "l.*"))
    categories = upsert.add_categories(
        tables.categories, rows.select("business_id", F.col("category").alias("slug")))
    merged = Tables(_merge_entities(tables.entities, rows, at), records,
                    upsert.replace_evidence(tables.evidence, touched, fresh), links, categories)
    stored = seen.join(rows.select(*KEY, F.lit(True).alias("stored")), KEY, "left").withColumn(
        "stored", F.coalesce("stored", F.lit(False)))
    return merged, stored.drop("country_code")


def _merge_entities(entities: DataFrame, rows: DataFrame, at: str) -> DataFrame:
    """Field-wise first value: what an entity has stays, gaps fill in listing order. Private
    locations never reach the entity."""
    now = F.lit(at).cast("timestamp")
    persian, latin = split_name("name")
    public = ~F.coalesce("private_location", F.lit(False))

    def first_link(kind: str, part: str):
        return F.get(F.filter("links", lambda x: x["kind"] == kind), F.lit(0))[part]

    place = F.when(public & F.col("lat").isNotNull() & F.col("lng").isNotNull(),
                   F.struct("lat", "lng"))
    fresh = rows.select(
        "business_id", "city_id", persian.alias("name_fa"), latin.alias("name_latin"),
        F.when(public, F.col("address")).alias("address"), place.alias("point"),
        first_link("phone", "value").alias("phone_e164"),
        first_link("website", "url").alias("website"), F.lit("active").alias("status"),
        now.alias("first_seen"), "_ord")
    old = entities.select(
        "business_id", "city_id", "name_fa", "name_latin", "address",
        F.when(F.col("lat").isNotNull(), F.struct("lat", "lng")).alias("point"), "phone_e164",
        "website", "status", "first_seen", F.lit("").alias("_ord"))
    names = [c for c in fresh.columns if c not in ("business_id", "_ord")]
    # dictionary of all fields in one aggregation; untouched entities skip it
    touched = rows.select("business_id").distinct()
    changed = survivorship(
        old.join(touched, "business_id", "left_semi").unionByName(fresh), "business_id", names,
        ["_ord"])
    scores = entities.select("business_id", "score", "label")
    changed = changed.join(scores, "business_id", "left").withColumn("last_verified_at", now)
    out = changed.select("*", "point.lat", "point.lng").select(*entities.columns)
    return entities.join(touched, "business_id", "left_anti").unionByName(out)


def prune_missing(tables: Tables, seen: DataFrame, failed: list[str] | None = None
                  ) -> tuple[Tables, DataFrame]:
    """Drop records a source no longer lists in a city where it listed something, then the
    entities without any record. Pages and channels are never pruned, nor is a failed
    source."""
    spared = ["website", "telegram", "user_submission", *(failed or [])]
    known = tables.records.where(~F.col("source_id").isin(*spared)).join(
        tables.entities.select("business_id", "city_id"), "business_id")
    missing = upsert.missing_records(known, seen, ["source_id", "city_id"])
    parts = upsert.prune(tables.entities, tables.records, tables.evidence, tables.links,
                         tables.categories, missing)
    return Tables(**parts), missing


def score_all(tables: Tables) -> Tables:
    scored = rescore(tables.entities, tables.evidence).select(*tables.entities.columns)
    return replace(tables, entities=scored)


def build_index(sources: Mapping[str, Callable[[], DataFrame] | DataFrame], tables: Tables,
                cities: DataFrame, countries: DataFrame, block_list: DataFrame, at: str, *,
                lexicon: Lexicon | None = None, order: tuple[str, ...] = fv.SOURCE_ORDER
                ) -> dict:
    """One batch run over all cities. ``sources`` maps a source id to its listings or to a
    function that makes them. A source whose scan cannot be set up counts as failed, stores
    nothing and loses nothing; all sources share one plan.

    Returns tables, stats (per source), category_counts and errors.
    """
    lexicon = lexicon or Lexicon.default()
    frames, errors = [], {}
    for source_id, make in sources.items():
        try:
            df = make() if callable(make) else make
            city = [F.col("city_id").cast("long")] if "city_id" in df.columns else []
            frames.append(df.select(*schemas.LISTING.names, *city))
        except Exception as exc:  # a broken source must not stop the others
            errors[source_id] = str(exc).splitlines()[0][:200]
    spark = cities.sparkSession
    error_rows = spark.createDataFrame(list(errors.items()) or [], "source_id string, error string")
    empty = spark.createDataFrame([], schemas.LISTING)
    merged = upsert.merge_sources(empty, *frames)
    placed = cut(assign_city(_last_of_key(merged), cities))
    out, seen = merge_listings(tables, placed, block_list, lexicon, at, order=order)
    seen = cut(seen)
    out, missing = prune_missing(out.settle(), seen, list(errors))
    out = score_all(out).settle()
    stats = analytics.run_stats(seen, missing, error_rows)
    visible = shown(out.entities, cities, countries)
    return {"tables": out, "stats": stats, "errors": errors, "seen": seen,
            "category_counts": analytics.category_counts(visible, out.categories)}


def refresh_candidates(tables: Tables, kind: str, checked: DataFrame, now: str, *,
                       days: int = fv.RECHECK_DAYS,
                       cut_score: float = fv.MIN_PAGE_CHECK_SCORE) -> DataFrame:
    """(business_id, city_id, url, value): first link of a kind of every active entity worth
    checking that was not checked in the last days. ``checked``: business_id, checked_at."""
    due = F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {int(days)} DAYS")
    worth = tables.entities.where((F.col("status") == "active") & (F.col("score") >= cut_score))
    recent = checked.where(F.col("checked_at") >= due).select("business_id")
    worth = worth.join(recent, "business_id", "left_anti").select("business_id", "city_id")
    first = first_link_per_entity(tables.links.join(worth, "business_id", "left_semi"), kind,
                                  ["value", "url"])
    return worth.join(first.select("business_id", "url", "value"), "business_id")


def _merge_check(tables: Tables, results: DataFrame, source_id: str, ident: str,
                 at: str) -> Tables:
    """Store evidence and links of checked pages. A check without evidence leaves an earlier
    record alone."""
    now = F.lit(at).cast("timestamp")
    hits = results.where(F.size("signals") > 0).withColumns({
        "source_id": F.lit(source_id), "external_id": F.col(ident)})
    # entities may share one page: the record belongs to the smallest of them
    owner = hits.groupBy(*KEY).agg(F.min("business_id").alias("business_id"))
    hits = hits.join(owner, [*KEY, "business_id"], "left_semi")
    records = upsert.upsert(tables.records, hits.select(
        *KEY, "business_id", F.col("final_url").alias("url"),
        F.to_json(F.struct("title")).alias("raw"), now.alias("fetched_at")), KEY)
    fresh = hits.select(*KEY, "business_id", "final_url", F.explode("signals").alias("s")).select(
        *KEY, "business_id", "s.signal", "s.weight", "s.snippet",
        F.coalesce("s.url", "final_url").alias("url"))
    links = tables.links
    if "links" in results.columns:
        links = upsert.add_links(links, results.select(
            "business_id", F.explode("links").alias("l")).select("business_id", "l.*"))
    return replace(tables, records=records, links=links,
                   evidence=upsert.replace_evidence(tables.evidence, hits, fresh))


def page_refresh(tables: Tables, pages: DataFrame, checked: DataFrame, cities: DataFrame,
                 now: str, lexicon: Lexicon | None = None) -> tuple[Tables, DataFrame, DataFrame]:
    """Read landed pages of due entities, merge their evidence and rescore.

    ``pages``: url, final_url, html, reason (null when read). Returns the tables, the new
    check times and the outcome counts. Network trouble leaves an entity due."""
    lexicon = lexicon or Lexicon.default()
    todo = refresh_candidates(tables, "website", checked, now)
    todo = todo.join(cities.select("city_id", F.col("country_code").alias("country")), "city_id",
                     "left")
    landed = todo.join(pages.withColumnRenamed("url", "_page"),
                       F.col("url") == F.col("_page")).drop("_page")
    ok = F.col("reason").isNull()
    landed = cut(landed.withColumn("final_url", F.coalesce("final_url", "url")))
    read = landed.where(ok).withColumn("url", F.col("final_url"))
    found = page_evidence(read.select("business_id", "country", "url", "final_url", "html"),
                          lexicon)
    kept = _without_excluded(found, lexicon)
    site = website_link("final_url")
    kept = cut(kept.withColumn("page_key", F.coalesce(site["url"], F.col("final_url"))))
    out = _merge_check(tables, kept, "website", "page_key", now)
    failed = landed.where(~ok)
    final = failed.where(~analytics.retryable(F.col("reason"), F.lit(False)))
    times = kept.select("business_id").unionByName(final.select("business_id")).distinct(
    ).withColumn("checked_at", F.lit(now).cast("timestamp"))
    outcomes = kept.select(F.lit(True).alias("ok"), F.lit(None).cast("string").alias("reason"),
                           F.size("signals").alias("signals")).unionByName(
        failed.select(F.lit(False).alias("ok"), "reason", F.lit(0).alias("signals")))
    return score_all(out), times, analytics.fetch_outcomes(outcomes)


def _without_excluded(found: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Drop keyword signals that rest on a word excluded in the entity's country. Only rows
    of countries with exclusions are unfolded."""
    key = ["business_id", "url"]
    codes = sorted(lexicon.exclusions)
    concerned = F.coalesce(F.upper("country").isin(*codes), F.lit(False)) if codes else F.lit(False)
    there = found.where(concerned)
    rows = there.select(*key, "country", F.posexplode("signals").alias("_i", "_s")).select(
        "business_id", F.col("url").alias("_page"), "country", "_i", "_s",
        F.col("_s.signal").alias("signal"), F.col("_s.snippet").alias("snippet"))
    lists = drop_excluded_keywords(rows, lexicon).groupBy("business_id", "_page").agg(
        F.array_sort(F.collect_list(F.struct("_i", "_s"))).alias("_l"))
    kept = there.drop("signals").join(
        lists.withColumnRenamed("_page", "url"), key, "left").withColumn(
        "signals", F.coalesce(F.transform("_l", lambda x: x["_s"]), F.array())).drop("_l")
    return found.where(~concerned).unionByName(kept)


def channel_refresh(tables: Tables, previews: DataFrame, checked: DataFrame, cities: DataFrame,
                    now: str, lexicon: Lexicon | None = None
                    ) -> tuple[Tables, DataFrame, DataFrame]:
    """The same for channel previews (name, url, html, retryable)."""
    lexicon = lexicon or Lexicon.default()
    todo = refresh_candidates(tables, "telegram", checked, now).select(
        "business_id", "city_id", F.col("value").alias("name"))
    todo = todo.join(cities.select("city_id", F.col("country_code").alias("country")), "city_id",
                     "left")
    landed = cut(todo.join(previews, "name"))
    again = F.coalesce("retryable", F.lit(False))
    found = channel_evidence(landed.where(~again).select("business_id", "country", "name", "url",
                                                         "html"), lexicon)
    kept = cut(_without_excluded(found, lexicon).withColumn("final_url", F.col("url")))
    out = _merge_check(tables, kept, "telegram", "name", now)
    times = kept.select("business_id").distinct().withColumn(
        "checked_at", F.lit(now).cast("timestamp"))
    outcomes = kept.select(F.lit(False).alias("retryable"), F.lit(True).alias("ok"), "exists",
                           F.size("signals").alias("signals")).unionByName(
        landed.where(again).select(F.lit(True).alias("retryable"), F.lit(False).alias("ok"),
                                   F.lit(False).alias("exists"), F.lit(0).alias("signals")))
    return score_all(out), times, analytics.channel_outcomes(outcomes)
