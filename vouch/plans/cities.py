"""City rows from a gazetteer of places."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vouch import fixed_values as fv
from vouch.functions.address import region_code
from vouch.functions.geo import metro_box
from vouch.functions.text import slugify
from vouch.operators.ranking import slug_dedupe
from vouch.operators.spatial import covering_city


def build_city_dim(places: DataFrame, cities: DataFrame, countries: DataFrame
                   ) -> dict[str, DataFrame]:
    """New city rows for a whole gazetteer at once.

    ``places``: osm_id, kind, name, name_en, name_fa, country_code, country_name, lat, lng,
    south, north, west, east, address (map of ISO codes). Only settlements outside the
    excluded countries count. A place inside the box of a known city of its country maps to
    that city; the rest become cities with a widened box and a unique slug.

    Returns mapped (osm_id, slug), cities and countries (only the new ones).
    """
    code = F.upper(F.coalesce("country_code", F.lit("")))
    kinds = [*fv.PLACE_RANK, *fv.EXTRA_PLACE_KINDS]
    fit = places.where(F.col("kind").isin(*kinds) & (F.length(code) == 2)
                       & ~code.isin(*fv.EXCLUDED_COUNTRIES)).withColumn("country_code", code)
    if "osm_id" in cities.columns:
        fit = fit.join(cities.select("osm_id"), "osm_id", "left_anti")
    mapped = covering_city(fit.select("osm_id", "country_code", "lat", "lng"), cities, "osm_id")
    new = fit.join(mapped.select("osm_id"), "osm_id", "left_anti")
    name_en = F.coalesce(F.nullif("name_en", F.lit("")), "name")
    box = metro_box("lat", "lng", "south", "north", "west", "east")
    region = region_code("address", "country_code")
    rows = new.select(
        "osm_id", "country_code", name_en.alias("name_en"),
        F.coalesce(F.nullif("name_fa", F.lit("")), name_en).alias("name_fa"), "lat", "lng",
        box.alias("_b"), F.array_compact(F.array(region)).alias("regions"),
        slugify(name_en).alias("slug")).select("*", "_b.*").drop("_b")
    rows = slug_dedupe(rows, cities.select("slug"))
    missing = new.select(F.col("country_code").alias("code"), "country_name").join(
        countries.select("code"), "code", "left_anti").groupBy("code").agg(
        F.min("country_name").alias("_n"))
    return {"mapped": mapped, "cities": rows,
            "countries": missing.select("code", F.coalesce("_n", "code").alias("name_en"))}
