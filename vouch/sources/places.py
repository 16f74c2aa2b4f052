"""Nested Parquet place releases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vouch import fixed_values as fv
from vouch.functions import categories
from vouch.functions.links import social_link
from vouch.sources.listing import make, signal, source, text_field

COLUMNS = (
    "id", "names.primary", "names.common", "taxonomy.hierarchy", "basic_category", "websites",
    "socials", "phones", "addresses", "sources", "operating_status", "bbox.xmin", "bbox.ymin",
    "bbox.xmax", "bbox.ymax",
)


def places_scan(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None
                = None, release: str | None = None) -> DataFrame:
    """The 15 nested columns in use, flattened. The box test is pushed to the row groups and
    ``release`` prunes partition folders."""
    df = spark.read.parquet(path)
    if release is not None and "release" in df.columns:
        df = df.where(F.col("release") == release)
    if box is not None:
        west, south, east, north = box
        df = df.where((F.col("bbox.xmin") >= west) & (F.col("bbox.xmax") <= east)
                      & (F.col("bbox.ymin") >= south) & (F.col("bbox.ymax") <= north))
    return flatten(df)


def flatten(places: DataFrame) -> DataFrame:
    names = {"names.primary": "name", "names.common": "common_names"}
    return places.select(*[F.col(c).alias(names.get(c, c.rsplit(".", 1)[-1])) for c in COLUMNS])


def latest_release(spark: SparkSession, root: str) -> str:
    """Newest release by name from the partition folders; fails when there is none."""
    try:
        row = spark.read.parquet(root).select(F.max("release").alias("r")).first()
    except Exception as exc:
        raise FileNotFoundError(f"no place releases under {root}") from exc
    if row is None or row.r is None:
        raise FileNotFoundError(f"no place releases under {root}")
    return str(row.r)


def newest_release(places: DataFrame) -> DataFrame:
    """Only the rows of the newest release; the sub-query prunes partitions at run time."""
    newest = places.groupBy().agg(F.max("release").alias("release"))
    return places.join(F.broadcast(newest), "release", "left_semi")


def _present(values: Column) -> Column:
    none = F.array().cast("array<string>")
    return F.filter(F.coalesce(values, none), lambda v: F.coalesce(v, F.lit("")) != "")


@source("overture")
def places_to_listing(places: DataFrame, keep: list[str] | None = None,
                      maps: tuple[dict, dict] | None = None) -> DataFrame:
    """Listings of flattened places: named and not permanently closed."""
    taxonomy, basic = maps or categories.default_maps()[:2]
    df = places.where((F.coalesce("name", F.lit("")) != "") & F.coalesce(
        F.col("operating_status") != fv.CLOSED_STATUS, F.lit(True)))
    df = df.withColumns({"_urls": F.concat(_present(F.col("socials")),
                                           _present(F.col("websites"))),
                         "_sites": _present(F.col("websites"))})
    df = df.withColumn("_social", F.array_compact(F.transform("_urls", social_link)))
    facebook = F.filter("_social", lambda x: x["kind"] == "facebook")
    own_site = F.filter("_sites", lambda u: social_link(u).isNull())
    df = df.withColumn("_shown", F.coalesce(F.get(facebook, F.lit(0))["url"],
                                            F.get(own_site, F.lit(0))))
    url = F.col("_shown")
    other_names = F.transform(
        _present(F.map_values("common_names")),
        lambda n: F.struct(F.lit("name").alias("kind"), n.alias("text"), url.alias("url")))
    handles = F.transform(
        F.filter("_social", lambda x: x["kind"] == "instagram"),
        lambda x: F.struct(F.lit("username").alias("kind"), x["value"].alias("text"),
                           x["url"].alias("url")))
    marked = F.array_contains("hierarchy", fv.PLACE_TAXONOMY_MARKER)
    first = F.get("addresses", F.lit(0))
    address = F.nullif(F.concat_ws(", ", *[F.nullif(first[c], F.lit(""))
                                           for c in ("freeform", "locality", "region")]),
                       F.lit(""))
    upstream = F.array_sort(F.array_distinct(_present(
        F.transform("sources", lambda s: s["dataset"]))))
    raw = F.to_json(F.struct("id", "name", F.col("hierarchy").alias("taxonomy"),
                             "basic_category", "websites", "socials", "phones",
                             upstream.alias("upstream")))
    return make(
        df, keep, source_id=F.lit("overture"), external_id="id", name="name", url=url,
        lng=(F.col("xmin") + F.col("xmax")) / 2, lat=(F.col("ymin") + F.col("ymax")) / 2,
        address=address,
        category=categories.map_hierarchy("hierarchy", "basic_category", taxonomy, basic),
        phones=_present(F.col("phones")), urls="_urls",
        texts=F.concat(F.array(text_field("name", F.col("name"), url)),
                       F.coalesce(other_names, F.array()), handles),
        signals=F.array_compact(F.array(signal(
            "overture_persian_category", F.coalesce(marked, F.lit(False)),
            F.lit(f"taxonomy: {fv.PLACE_TAXONOMY_MARKER}"), url))),
        raw=raw)


@source("osm")
def osm_to_listing(elements: DataFrame, keep: list[str] | None = None,
                   rules: list[tuple[str, str]] | None = None) -> DataFrame:
    """Listings of map elements that have a name and one of the point-of-interest keys."""
    rules = rules or categories.default_maps()[2]

    def tag(key: str) -> Column:
        return F.nullif(F.try_element_at("tags", F.lit(key)), F.lit(""))

    poi = F.arrays_overlap(F.map_keys("tags"), F.array(*[F.lit(k) for k in fv.OSM_POI_KEYS]))
    base = F.coalesce(tag("name"), tag("name:en"), tag("name:fa"))
    df = elements.where(F.coalesce(poi, F.lit(False)) & base.isNotNull())
    fa = tag("name:fa")
    name = F.when(fa.isNotNull() & (fa != base), F.concat(base, F.lit(" | "), fa)).otherwise(base)
    ref = F.concat_ws("/", "type", F.col("id").cast("string"))
    url = F.concat(F.lit(fv.OSM_PAGE), ref)
    names = F.array_distinct(F.array_compact(F.array(
        *[tag(k) for k in ("name", "name:en", "alt_name", "brand")])))
    name_fields = F.transform(names, lambda n: F.struct(
        F.lit("name").alias("kind"), n.alias("text"), url.alias("url")))
    about = F.array_compact(F.array(text_field("text", tag("description"), url)))
    cuisine = F.coalesce(tag("cuisine"), F.lit(""))
    persian = F.exists(F.split(cuisine, ";"),
                       lambda c: F.lower(F.trim(c)).isin("persian", "iranian"))
    urls = F.transform(
        F.array_compact(F.array(*[tag(k) for k in fv.OSM_LINK_KEYS])),
        lambda u: F.when(u.contains("/") | u.contains("."), u).otherwise(F.concat(
            F.lit("https://www.instagram.com/"), F.regexp_replace(u, "^@+", ""))))
    phones = F.filter(F.transform(F.flatten(F.array(*[
        F.split(F.coalesce(tag(k), F.lit("")), ";") for k in ("phone", "contact:phone")])),
        lambda p: F.trim(p)), lambda p: p != "")
    street = F.concat_ws(" ", tag("addr:housenumber"), tag("addr:street"))
    address = F.nullif(F.concat_ws(", ", F.nullif(street, F.lit("")), tag("addr:city"),
                                   tag("addr:postcode")), F.lit(""))
    return make(
        df, keep, source_id=F.lit("osm"), external_id=ref, name=name, url=url,
        lat=F.coalesce("lat", "center.lat"), lng=F.coalesce("lon", "center.lon"),
        address=address, category=categories.map_tags("tags", rules), phones=phones, urls=urls,
        texts=F.concat(name_fields, about),
        signals=F.array_compact(F.array(
            signal("osm_cuisine_tag", persian, F.concat(F.lit("cuisine="), cuisine), url),
            signal("osm_language_fa", F.coalesce(tag("language:fa") == "yes", F.lit(False)),
                   F.lit("language:fa=yes"), url))),
        raw=F.to_json(F.struct("type", "id", "tags")))


def osm_candidates(elements: DataFrame) -> DataFrame:
    """Elements worth reading: the cheap key test first, then any of the hints."""
    def tag(key: str) -> Column:
        return F.coalesce(F.try_element_at("tags", F.lit(key)), F.lit(""))

    poi = F.arrays_overlap(F.map_keys("tags"), F.array(*[F.lit(k) for k in fv.OSM_POI_KEYS]))
    hint = (tag("cuisine").rlike("(?i)persian|iranian") | (tag("language:fa") == "yes")
            | tag("name").rlike(f"[{fv.PERSIAN_LETTERS}]")
            | tag("name").rlike(f"(?i){fv.OSM_NAME_HINTS}")
            | tag("description").rlike("(?i)persian|iranian|farsi"))
    return elements.where(F.coalesce(poi, F.lit(False))).where(hint)


def read_osm(spark: SparkSession, path: str) -> DataFrame:
    """Map elements, one JSON object per line."""
    from vouch.schemas import OSM_ELEMENT

    return spark.read.schema(OSM_ELEMENT).json(path)


