"""First-per-group, survivorship, ordering and top-k operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vouch import fixed_values as fv
from vouch.functions.geo import distance_m
from vouch.operators.lineage import cut


def first_by(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row per key in ``order``, as an aggregate that combines map-side (a window
    would move and sort every row of a hot key in one task)."""
    named = [(o if isinstance(o, Column) else F.col(o)).alias(f"_o{i}")
             for i, o in enumerate(order)]
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min(F.struct(*named, *rest)).alias("_b"))
    return best.select(*keys, *[F.col(f"_b.{c}").alias(c) for c in rest])


def first_link_per_entity(links: DataFrame, kind: str, order: list[str]) -> DataFrame:
    """First link of one kind per entity."""
    return first_by(links.where(F.col("kind") == kind), ["business_id"], order)


def first_record_per_source(records: DataFrame, links: DataFrame,
                            kinds: tuple[str, ...] = fv.SOCIAL_KINDS) -> DataFrame:
    """(business_id, source, url): earliest record per entity and source; social links fill
    in for kinds no record stands for. ``links`` needs an ``ord`` column."""
    from_records = records.select(
        "business_id", F.col("source_id").alias("source"), F.lit(0).alias("prio"),
        F.col("fetched_at").alias("at"), F.lit(0).cast("long").alias("ord"), "url")
    from_links = links.where(F.col("kind").isin(*kinds)).select(
        "business_id", F.col("kind").alias("source"), F.lit(1).alias("prio"),
        F.lit(None).cast("timestamp").alias("at"), F.col("ord").cast("long").alias("ord"), "url")
    both = from_records.unionByName(from_links)
    return first_by(both, ["business_id", "source"], ["prio", "at", "ord", "url"]).select(
        "business_id", "source", "url")


def ranked(df: DataFrame, keys: list[str], order: list[Column | str],
           partitions: int | None = None) -> DataFrame:
    """Add ``position`` (1, 2, ...) per key in ``order`` without sorting a key in one task.

    Rows are range-partitioned on key and order, so a key with very many rows spreads over
    several partitions; numbering inside a partition plus the row counts of the key in the
    partitions before gives the position. The numbered rows are checkpointed, because they
    are read twice and must not be numbered again after a failure."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = cut(df.repartitionByRange(n, *keys, *order).sortWithinPartitions(*keys, *order)
                  .withColumn("_id", F.monotonically_increasing_id()))
    sorted_ = sorted_.withColumn("_part", F.shiftright("_id", 33))
    chunks = sorted_.groupBy(*keys, "_part").agg(F.min("_id").alias("_lo"),
                                                 F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1)
    chunks = chunks.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    out = sorted_.join(chunks, [*keys, "_part"])
    return out.withColumn("position", F.col("_id") - F.col("_lo") + 1 + F.col("_before")).drop(
        "_id", "_part", "_lo", "_n", "_before")


def evidence_rank(evidence: DataFrame, order: list[str]) -> DataFrame:
    """Evidence rows with their position inside the entity's card, strongest first."""
    return ranked(evidence, ["business_id"], [F.desc("weight"), *order])


def survivorship(records: DataFrame, key: str, fields: list[str], order: list[str]) -> DataFrame:
    """Field-wise first non-null value in ``order``: one hash aggregation for all fields."""
    picks = [F.min(F.when(F.col(f).isNotNull(), F.struct(
        *order, F.col(f).alias("_v"))))["_v"].alias(f) for f in fields]
    return records.groupBy(key).agg(*picks)


def label_sample(shown: DataFrame, labels: DataFrame, per_level: int, seed: str = "0") -> DataFrame:
    """Up to ``per_level`` shown, unlabelled entities of every level in a seeded random order.

    The order is a hash of the id. Each level is cut first inside hash buckets and then
    overall, so no task sorts a whole level."""
    pool = shown.join(labels.select("business_id"), "business_id", "left_anti").where(
        F.col("label").isNotNull()).select("business_id", F.col("label").alias("level"))
    pool = pool.withColumn("_h", F.md5(F.concat_ws("|", F.lit(seed), "business_id")))
    return top_per_group(pool, ["level"], ["_h", "business_id"], per_level).drop("_h")


def top_per_group(df: DataFrame, keys: list[str], order: list[Column | str], n: int,
                  buckets: int = 64) -> DataFrame:
    """First ``n`` rows per key. Exact in two steps: n per (key, bucket), then n per key."""
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(buckets)))
    first = Window.partitionBy(*keys, "_salt").orderBy(*order)
    cut = salted.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= n)
    final = Window.partitionBy(*keys).orderBy(*order)
    out = cut.drop("_salt", "_r").withColumn("position", F.row_number().over(final))
    return out.where(F.col("position") <= n)


def slug_dedupe(cities: DataFrame, taken: DataFrame) -> DataFrame:
    """Give every new city a unique slug: slug, else slug-cc, else slug-cc-osmid.

    ``cities``: slug, country_code, osm_id; ``taken``: slug. Among new cities the first by
    osm_id gets the plain slug, as if they were added one by one in that order. Numbering goes
    through ``ranked``, because names that fold to nothing all share one slug."""
    used = taken.select("slug", F.lit(True).alias("_used")).distinct()
    cc = F.concat_ws("-", "slug", F.lower("country_code"))
    df = ranked(cities, ["slug"], ["osm_id"]).join(used, "slug", "left")
    plain = F.col("_used").isNull() & (F.col("position") == 1)
    df = df.withColumn("_base", F.col("slug")).withColumn(
        "slug", F.when(plain, F.col("slug")).otherwise(cc)).withColumn("_plain", plain)
    # a suffixed slug can meet another one, a plain one, or one already taken
    df = ranked(df.drop("_used", "position"), ["slug"], [F.desc("_plain"), "osm_id"]).join(
        used, "slug", "left")
    again = ~F.col("_plain") & (F.col("_used").isNotNull() | (F.col("position") > 1))
    df = df.withColumn("slug", F.when(again, F.concat_ws(
        "-", "slug", F.lower("osm_id"))).otherwise(F.col("slug")))
    return df.drop("_used", "position", "_base", "_plain")


def page_key(sort: str, *, lat: float | None = None, lng: float | None = None) -> Column:
    """The place of a result in the order of ``sort`` as one comparable struct: by confidence, name
    or distance, missing values last; the id breaks every tie. It is also the cursor of a page."""
    def last(c: Column, empty) -> list[Column]:
        return [c.isNull(), F.coalesce(c, F.lit(empty))]

    name = last(F.coalesce("name_latin", "name_fa"), "")
    if sort == "distance":
        if lat is None or lng is None:
            raise ValueError("sort by distance needs lat and lng")
        parts = [*last(distance_m("lat", "lng", F.lit(lat), F.lit(lng)), 0.0), *name]
    elif sort == "name":
        parts = name
    elif sort == "confidence":
        parts = [*last(-F.col("score"), 0.0), *name]
    else:
        raise ValueError(f"unknown sort {sort!r}")
    parts.append(F.col("business_id"))
    return F.struct(*[p.alias(f"k{i}") for i, p in enumerate(parts)])


def search_page(results: DataFrame, sort: str, page: int, page_size: int, *,
                lat: float | None = None, lng: float | None = None,
                after: tuple | None = None) -> DataFrame:
    """One page of results: by confidence, name or distance; the id breaks every tie.

    ``after`` is the ``page_key`` of the last row that was seen. The page then starts right behind
    it by a filter, so a late page keeps ``page_size`` rows a task like the first; ``page`` counts
    from there. Without it, earlier pages are skipped, which gathers them in one task."""
    key = page_key(sort, lat=lat, lng=lng)
    if after is not None:
        results = results.where(key > F.struct(*[F.lit(v).alias(f"k{i}") for i, v in enumerate(after)]))
    ordered = results.orderBy(key)
    if page > 1:
        ordered = ordered.offset((page - 1) * page_size)
    return ordered.limit(page_size)


def markers(results: DataFrame, limit: int = fv.MAX_MARKERS) -> DataFrame:
    """Located results for a map, best first; the limit is part of the report."""
    located = results.where(F.col("lat").isNotNull() & F.col("lng").isNotNull())
    return located.orderBy(F.desc("score"), "business_id").limit(limit).select(
        "business_id", "name_latin", "label", F.round("lat", 6).alias("lat"),
        F.round("lng", 6).alias("lng"))


def most_reported(reports: DataFrame) -> DataFrame:
    """(business_id, reports): most reported first, older first report first among equals."""
    counted = reports.groupBy("business_id").agg(
        F.count(F.lit(1)).alias("reports"), F.min("created_at").alias("first_at"))
    return counted.orderBy(F.desc("reports"), "first_at", "business_id")


def recent_jobs(jobs: DataFrame, since: Column, limit: int = fv.MAX_RECENT_JOBS) -> DataFrame:
    """Jobs created since a time, newest first; the limit is part of the report."""
    return jobs.where(F.col("created_at") >= since).orderBy(
        F.desc("created_at"), F.desc("job_id")).limit(limit)


def settlement_filter(places: DataFrame) -> DataFrame:
    """Usable place suggestions with their rank: settlements with id and name, outside the
    excluded countries, each distinct suggestion once (its first appearance by ``ord``)."""
    code = F.upper(F.coalesce("countrycode", F.lit("")))
    rank = F.create_map(*[F.lit(x) for kv in fv.PLACE_RANK.items() for x in kv])
    some = [F.coalesce(F.col(c).cast("string"), F.lit("")) != ""
            for c in ("osm_type", "osm_id", "name")]
    kept = places.where((F.col("osm_key") == "place") & F.col("osm_value").isin(*fv.PLACE_RANK)
                        & some[0] & some[1] & some[2] & ~code.isin(*fv.EXCLUDED_COUNTRIES))
    out = kept.select(
        F.concat(F.col("osm_type"), F.col("osm_id").cast("string")).alias("osm_id"), "name",
        "state", "country", F.nullif(code, F.lit("")).alias("country_code"),
        rank[F.col("osm_value")].alias("rank"), "ord")
    return first_by(out, ["osm_id", "name", "state", "country", "country_code"], ["ord", "rank"])


def suggestions(places: DataFrame, limit: int = fv.MAX_SUGGESTIONS) -> DataFrame:
    """The first suggestions by settlement rank, input order inside a rank."""
    return settlement_filter(places).orderBy("rank", "ord").limit(limit)


def nest_hierarchy(rows: DataFrame) -> DataFrame:
    """Parents with their children as an array in ``position`` order."""
    kids = rows.where(F.col("parent_slug").isNotNull()).groupBy(
        F.col("parent_slug").alias("slug")).agg(F.array_sort(F.collect_list(
            F.struct("position", F.col("slug").alias("child")))).alias("_kids"))
    top = rows.where(F.col("parent_slug").isNull()).select("slug", "position")
    children = F.transform(F.coalesce("_kids", F.array().cast(
        "array<struct<position:int,child:string>>")), lambda k: k["child"])
    return top.join(kids, "slug", "left").select("slug", "position",
                                                 children.alias("children"))


def hidden_list(entities: DataFrame) -> DataFrame:
    return entities.where(F.col("status") == "hidden").orderBy(
        F.col("name_latin").asc_nulls_last(), "business_id")
