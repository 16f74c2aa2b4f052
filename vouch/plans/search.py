"""Search, markers and cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vouch import fixed_values as fv
from vouch.functions.links import map_urls
from vouch.functions.scoring import min_confidence
from vouch.operators.evidence import with_threshold
from vouch.operators.filters import category_expand, from_sources, in_categories, registry_links
from vouch.operators.ranking import first_record_per_source, markers, search_page


def search_results(entities: DataFrame, entity_categories: DataFrame, records: DataFrame,
                   links: DataFrame, cities: DataFrame, countries: DataFrame,
                   categories: DataFrame, *, city: str, country: str, wanted: list[str],
                   level: str = "low", sources: list[str] | None = None) -> DataFrame:
    """Entities of one city that a search shows, unsorted. Filters run before any join, and
    all joins to detail tables are semi joins."""
    here = cities.where((F.col("slug") == city) & (F.col("country_code") == country.upper()))
    df = entities.where(F.col("status") == "active").join(
        here.select("city_id"), "city_id", "left_semi")
    df = with_threshold(df, here, countries)
    df = df.where(F.col("score") >= min_confidence(level, "threshold")).drop("threshold")
    df = in_categories(df, entity_categories, category_expand(categories, wanted))
    if sources:
        df = from_sources(df, records, links, sources)
    return df


def cards(page: DataFrame, entity_categories: DataFrame, records: DataFrame, links: DataFrame,
          evidence: DataFrame) -> DataFrame:
    """Complete cards for a page of entities. The page is cut first; each detail table is
    reduced to the page by a semi join, folded to one row per entity and joined once."""
    ids = page.select("business_id")

    def of_page(df: DataFrame) -> DataFrame:
        return df.join(ids, "business_id", "left_semi")

    cats = of_page(entity_categories).groupBy("business_id").agg(
        F.array_sort(F.collect_list("slug")).alias("categories"))
    mine = of_page(links)
    order = F.col("link_id").cast("long") if "link_id" in links.columns else F.lit(0).cast("long")
    first = first_record_per_source(of_page(records), mine.withColumn("ord", order))
    found_in = first.groupBy("business_id").agg(F.array_sort(F.collect_list(
        F.struct("source", "url"))).alias("sources"))
    social = mine.where(F.col("kind").isin(*fv.SOCIAL_KINDS)).groupBy("business_id", "kind").agg(
        F.max(F.struct(order.alias("o"), "value", "url"))["url"].alias("url"))
    socials = social.groupBy("business_id").agg(F.map_from_entries(F.array_sort(F.collect_list(
        F.struct("kind", "url")))).alias("socials"))
    proof = of_page(evidence).groupBy("business_id").agg(F.array_sort(F.collect_list(F.struct(
        (-F.col("weight")).alias("w"), "signal", "snippet", "url", "source_id"))).alias("_e"))
    proof = proof.select("business_id", F.transform("_e", lambda e: F.struct(
        e["signal"].alias("signal"), (-e["w"]).alias("weight"), e["snippet"].alias("snippet"),
        e["url"].alias("url"), e["source_id"].alias("source"))).alias("evidence"))
    out = page
    for part in (cats, found_in, socials, proof):
        out = out.join(part, "business_id", "left")
    name = F.coalesce("name_latin", "name_fa", F.lit(""))
    return out.withColumn("links", map_urls(name, "address", "lat", "lng"))


def search(tables, cities: DataFrame, countries: DataFrame, categories: DataFrame, *, city: str,
           country: str, wanted: list[str], level: str = "low",
           sources: list[str] | None = None, sort: str = "confidence", page: int = 1,
           page_size: int = 20, lat: float | None = None, lng: float | None = None,
           after: tuple | None = None, registries: DataFrame | None = None) -> dict[str, DataFrame]:
    """total, results (cards of one page), markers and registry links of a search."""
    found = search_results(
        tables.entities, tables.categories, tables.records, tables.links, cities, countries,
        categories, city=city, country=country, wanted=wanted, level=level, sources=sources)
    one = search_page(found, sort, page, page_size, lat=lat, lng=lng, after=after)
    out = {
        "total": found.agg(F.count(F.lit(1)).alias("total")),
        "results": cards(one, tables.categories, tables.records, tables.links, tables.evidence),
        "markers": markers(found),
    }
    if registries is not None:
        slugs = [r.slug for r in category_expand(categories, wanted).collect()]
        out["registry_links"] = registry_links(cities.where(F.col("slug") == city), registries,
                                               slugs)
    return out


def localized(code: str, rows: DataFrame, labels: DataFrame, out: str = "label") -> DataFrame:
    """Label of each code in ``labels`` (code, label), the code itself where there is none."""
    named = labels.select(F.col("code").alias(code), F.col("label").alias("_label"))
    joined = rows.join(named, code, "left")
    return joined.withColumn(out, F.coalesce("_label", F.col(code))).drop("_label")


def localized_name(lang: str) -> Column:
    first, second = ("name_fa", "name_en") if lang == "fa" else ("name_en", "name_fa")
    return F.coalesce(F.col(first), F.col(second))
