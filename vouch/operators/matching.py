"""Matching listings to entities: same record, shared link, near and similar name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vouch import fixed_values as fv
from vouch.functions import text as tx
from vouch.operators.near_names import similar_within
from vouch.operators.spatial import min_id_within

KEY = ["source_id", "external_id"]


def record_match(listings: DataFrame, records: DataFrame) -> DataFrame:
    """(key, business_id) of listings whose source record is already known."""
    known = records.select(*KEY, "business_id")
    return listings.select(*KEY).join(known, KEY)


def link_match(listings: DataFrame, entities: DataFrame, entity_links: DataFrame, *,
               key: list[str] | None = None,
               meters: float = fv.SAME_LINK_METERS) -> DataFrame:
    """(key, business_id): smallest entity of the city that shares a link, skipping pairs
    that are both located and more than ``meters`` apart.

    ``listings``: key, city_id, lat, lng, links; ``entities``: business_id, city_id, lat, lng;
    ``entity_links``: business_id, kind, value. A link shared by very many rows is folded to
    one row per link for unlocated partners and to sub-cells for located ones.
    """
    key = key or KEY
    link = ["city_id", "kind", "value"]
    wanted = (listings.select(*key, "city_id", "lat", "lng", F.explode("links").alias("l"))
              .select(*key, "city_id", "lat", "lng", "l.kind", "l.value"))
    held = entity_links.select("business_id", "kind", "value").join(
        entities.select("business_id", "city_id", "lat", "lng"), "business_id")
    unlocated = F.col("lat").isNull() | F.col("lng").isNull()
    per_link = held.groupBy(*link).agg(
        F.min("business_id").alias("any_id"),
        F.min(F.when(unlocated, F.col("business_id"))).alias("unlocated_id"))
    loose = wanted.join(per_link, link).select(
        *key, F.when(unlocated, F.col("any_id")).otherwise(F.col("unlocated_id"))
        .alias("business_id"))
    near = min_id_within(wanted, held, link, meters, "business_id")
    close = wanted.join(near, [*link, "lat", "lng"]).select(*key, "business_id")
    both = loose.where(F.col("business_id").isNotNull()).unionByName(close)
    return both.groupBy(*key).agg(F.min("business_id").alias("business_id"))


def with_name_keys(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Add ``name_keys``: the distinct normalised names of the row."""
    keys = F.array_distinct(F.array_compact(F.array(*[
        F.nullif(tx.normalize_name(c), F.lit("")) for c in columns])))
    return rows.withColumn("name_keys", keys)


def nearby_match(listings: DataFrame, entities: DataFrame, *, key: list[str] | None = None,
                 name_columns: tuple[str, ...] = ("name_latin", "name_fa"),
                 meters: float = fv.NEARBY_METERS, cut: float = fv.NAME_SIMILARITY_CUT,
                 smallest: bool = False,
                 settle: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """(key, business_id, similarity): the most similar entity of the city in reach.

    Ties go to an equal name, then to the smaller id; with ``smallest`` any similar entity
    counts and the smallest id wins. Equal names, the usual hot case, never form pairs: they
    are answered per sub-cell. Other names meet by their rare parts (``near_names``) and are
    compared once per distinct pair. Rows may bring prepared ``name_keys``; ``settle`` may store
    what is read several times: the prepared names, the equal-name answer, the names' parts.
    """
    key = key or KEY
    if "name_keys" not in listings.columns:
        listings = with_name_keys(listings, ("name",))
    if "name_keys" not in entities.columns:
        entities = with_name_keys(entities, name_columns)
    located = F.col("lat").isNotNull() & F.col("lng").isNotNull()
    near = listings.where(located).select(*key, "city_id", "lat", "lng",
                                          F.get("name_keys", F.lit(0)).alias("name"))
    near = settle(near.where(F.col("name").isNotNull()))
    held = settle(entities.where(located).select("business_id", "city_id", "lat", "lng",
                                                 F.explode("name_keys").alias("name")))
    place = ["city_id", "name", "lat", "lng"]
    equal = settle(min_id_within(near, held, ["city_id", "name"], meters, "business_id"))
    asked = near.select(*place).distinct()
    if not smallest:
        asked = asked.join(equal.select(*place), place, "left_anti")
    others = held.groupBy(*place).agg(F.min("business_id").alias("business_id")).select(
        "city_id", F.col("name").alias("r_name"), F.col("lat").alias("r_lat"),
        F.col("lng").alias("r_lng"), "business_id")
    similar = similar_within(asked, others, ["city_id"], meters, cut, settle)
    found = equal.withColumn("similarity", F.lit(100.0)).withColumn("equal", F.lit(1))
    found = found.unionByName(similar.select(*place, "business_id", "similarity",
                                             F.lit(0).alias("equal")))
    order = ("business_id",) if smallest else ("s", "e", "business_id")
    ranked = F.struct(*[{"s": (-F.col("similarity")).alias("s"), "e": (-F.col("equal")).alias("e")}
                        .get(o, F.col("business_id")) for o in order],
                      F.col("similarity").alias("similarity"))
    best = found.groupBy(*place).agg(F.min(ranked).alias("b"))
    return near.join(best, place).select(*key, "b.business_id", "b.similarity")
