"""Listing pages of community directories."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vouch import fixed_values as fv
from vouch.functions import categories
from vouch.functions.links import classify_url, url_parts
from vouch.operators.analytics import shared_links
from vouch.sources.html import plain_html
from vouch.sources.listing import make, number, signal, source, text_field, texts
from vouch.sources.pages import read_pages

_NODE = T.StructType([
    T.StructField("@type", T.StringType()), T.StructField("name", T.StringType()),
    T.StructField("description", T.StringType()), T.StructField("telephone", T.StringType()),
    T.StructField("additionalType", T.StringType()),
    T.StructField("sameAs", T.ArrayType(T.StringType())),
    T.StructField("geo", T.StructType([T.StructField("latitude", T.StringType()),
                                       T.StructField("longitude", T.StringType())])),
])
_GRAPH = T.StructType([T.StructField("@graph", T.ArrayType(_NODE)), *_NODE.fields])


def external_links(hrefs: Column, directory: Mapping) -> Column:
    """Distinct outside links of a page without the directory's own accounts and maps."""
    own = "|".join(d.replace(".", r"\.") for d in directory["own_domains"])

    def link(href: Column) -> Column:
        h = F.trim(href)
        host = url_parts(h)["hostname"]
        ours = host.rlike(f"(?:{own})$") | host.contains("google.") | host.contains("maps.apple")
        found = classify_url(h)
        fine = h.startswith("http") & ~ours & ~found["value"].isin(*directory["own_socials"])
        return F.when(fine, found["url"])

    return F.array_distinct(F.array_compact(F.transform(hrefs, link)))


def directory_entries(pages: DataFrame, directory: Mapping) -> DataFrame:
    """(url, name, description, lat, lng, phone, links, kind) of pages that are entries."""
    df = read_pages(pages).withColumn("_out", external_links(F.col("hrefs"), directory))
    if directory["variant"] == "json_ld":
        return _json_ld_entries(df)
    return _heading_entries(df)


def _json_ld_entries(df: DataFrame) -> DataFrame:
    """The first LocalBusiness node of the page's structured data, graphs included."""
    def nodes(text: Column) -> Column:
        doc = F.from_json(text, _GRAPH)
        own = F.struct(*[doc[f.name].alias(f.name) for f in _NODE.fields])
        return F.coalesce(doc["@graph"], F.array(own))

    every = F.flatten(F.transform("json_ld", nodes))
    local = F.filter(every, lambda n: n["@type"] == "LocalBusiness")
    df = df.withColumn("_n", F.get(local, F.lit(0))).where(F.col("_n").isNotNull())
    same = F.coalesce("_n.sameAs", F.array().cast("array<string>"))
    return df.select(
        "url", F.trim(plain_html("_n.name")).alias("name"),
        F.coalesce(plain_html("_n.description"), F.lit("")).alias("description"),
        number(F.col("_n.geo.latitude")).alias("lat"),
        number(F.col("_n.geo.longitude")).alias("lng"), F.col("_n.telephone").alias("phone"),
        F.concat(same, F.array_except("_out", same)).alias("links"),
        F.coalesce("_n.additionalType", F.lit("")).alias("kind")
    ).where(F.coalesce("name", F.lit("")) != "")


def _heading_entries(df: DataFrame) -> DataFrame:
    """Heading, the first map link with coordinates and the first telephone link."""
    at = r"(?:destination|query|q)=(-?\d{1,3}\.\d+),(-?\d{1,3}\.\d+)"
    decoded = F.transform("hrefs", lambda h: F.when(h.contains("google."), F.coalesce(
        F.try_url_decode(F.replace(h, F.lit("+"), F.lit("%2B"))), h)))
    spot = F.get(F.filter(decoded, lambda h: h.rlike(at)), F.lit(0))
    phone = F.get(F.filter("hrefs", lambda h: h.startswith("tel:")), F.lit(0))
    return df.where(F.coalesce("heading", F.lit("")) != "").select(
        "url", F.col("heading").alias("name"),
        F.coalesce("og_description", F.lit("")).alias("description"),
        number(F.regexp_extract(spot, at, 1)).alias("lat"),
        number(F.regexp_extract(spot, at, 2)).alias("lng"),
        F.substr(phone, F.lit(5)).alias("phone"), F.col("_out").alias("links"),
        F.lit("").alias("kind"))


def drop_template_links(entries: DataFrame, limit: int = fv.SHARED_LINK_LIMIT) -> DataFrame:
    """Entries without the links that more than ``limit`` entries carry."""
    pairs = entries.select("url", F.posexplode("links").alias("_i", "_u")).withColumn(
        "value", classify_url("_u")["value"])
    common = shared_links(pairs.where(F.col("value").isNotNull()), "url", "value", limit)
    own = pairs.join(common.select("value"), "value", "left_anti")
    lists = own.groupBy("url").agg(F.array_sort(F.collect_list(F.struct("_i", "_u"))).alias("_l"))
    kept = F.transform("_l", lambda x: x["_u"])
    return entries.join(lists, "url", "left").withColumn(
        "links", F.coalesce(kept, F.array().cast("array<string>"))).drop("_l")


@source("directory")
def directory_listings(pages: DataFrame, source_id: str,
                       directories: Mapping[str, Mapping] = fv.DIRECTORIES,
                       keep: list[str] | None = None) -> DataFrame:
    """Located entries of one directory as listings. The business listed itself there, which
    is evidence; descriptions are read but never stored."""
    directory = directories[source_id]
    df = drop_template_links(directory_entries(pages, directory)).where(
        F.col("lat").isNotNull() & F.col("lng").isNotNull())
    url = F.col("url")
    return make(
        df, keep, source_id=F.lit(source_id), external_id=url, name="name", url=url, lat="lat",
        lng="lng",
        category=categories.map_needles(F.concat_ws(" ", "kind", "name", "url"),
                                        fv.DIRECTORY_CATEGORY),
        phones=F.array_compact(F.array(F.nullif("phone", F.lit("")))), urls="links",
        texts=texts(text_field("name", F.col("name"), url),
                    text_field("text", F.col("description"), url)),
        signals=F.array_compact(F.array(signal("listed_in_iranian_directory", F.lit(True),
                                               F.lit(directory["home"]), url))),
        raw=F.to_json(F.struct("name", "kind")))
