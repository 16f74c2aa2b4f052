"""Which cities are due, and the administrator's overview."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vouch import fixed_values as fv


def due_cities(cities: DataFrame, status: DataFrame, now: str, latest_release: str | None = None,
               *, days: int = fv.REINDEX_AFTER_DAYS) -> DataFrame:
    """(slug, reason) of enabled cities: never_indexed, stale or new_overture_release.

    ``status``: city_id, last_indexed_at, release (of the places source)."""
    old = F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {int(days)} DAYS")
    joined = cities.where("enabled").join(
        status.select("city_id", "last_indexed_at", "release"), "city_id", "left")
    newer = F.coalesce(F.nullif("release", F.lit("")) < F.lit(latest_release).cast("string"),
                       F.lit(False))
    reason = (F.when(F.col("last_indexed_at").isNull(), "never_indexed")
              .when(F.col("last_indexed_at") < old, "stale")
              .when(newer, "new_overture_release"))
    return joined.select("slug", reason.alias("reason")).where(F.col("reason").isNotNull())


def city_overview(cities: DataFrame, status: DataFrame) -> DataFrame:
    """Per city: last run, entities shown by the last run, failed sources with their error.

    ``status``: city_id, last_indexed_at, category_counts map, per_source map of structs."""
    joined = cities.select("city_id", "slug", "country_code").join(status, "city_id", "left")
    total = F.aggregate(F.map_values("category_counts"), F.lit(0).cast("long"),
                        lambda acc, x: acc + x)
    failed = F.map_filter("per_source", lambda k, v: F.coalesce(v["error"], F.lit("")) != "")
    return joined.select("slug", "country_code", "last_indexed_at",
                         F.coalesce(total, F.lit(0).cast("long")).alias("shown"),
                         F.transform_values(failed, lambda k, v: v["error"]).alias("failed"))
