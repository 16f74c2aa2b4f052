"""Fusing evidence into entity scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vouch import fixed_values as fv
from vouch.functions.scoring import confidence_label, damped


def best_per_signal(evidence: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Strongest row per key and signal; ``order`` decides among equal weights."""
    rest = [c for c in evidence.columns if c not in (*keys, "signal", "weight")]
    ranked = F.struct((-F.col("weight")).alias("_w"), *order,
                      F.struct("weight", *rest).alias("_row"))
    best = evidence.groupBy(*keys, "signal").agg(F.min(ranked)["_row"].alias("_b"))
    return best.select(*keys, "signal", "_b.*")


def noisy_or(evidence: DataFrame, keys: list[str], negative: Column | None = None) -> DataFrame:
    """Score per key: 1 - prod(1 - strongest weight per positive signal), damped once when
    there is negative evidence. Two aggregations on the same keys; the first one combines
    map-side, so an entity with very much evidence never reaches one task in full."""
    if negative is None:
        negative = F.col("signal") == fv.NEGATIVE_SIGNAL
    strongest = evidence.where(F.col("signal").isNotNull()).groupBy(
        *keys, negative.alias("_neg"), F.when(~negative, F.col("signal")).alias("_sig")
    ).agg(F.max("weight").alias("_w"))
    fused = strongest.groupBy(*keys).agg(
        F.product(F.when(~F.col("_neg"), 1 - F.col("_w"))).alias("_p"),
        F.max("_neg").alias("_n"))
    return fused.select(*keys, damped(F.col("_p"), F.col("_n")).alias("score"))


def evidence_outer(entities: DataFrame, evidence: DataFrame, key: str = "business_id") -> DataFrame:
    """Every entity with its evidence rows, or with nulls when it has none."""
    return entities.join(evidence, key, "left")


def rescore(entities: DataFrame, evidence: DataFrame, key: str = "business_id",
            negative: Column | None = None) -> DataFrame:
    """Entities with fresh score and label; those without evidence get 0 and no label."""
    kept = [c for c in entities.columns if c not in ("score", "label")]
    fused = noisy_or(evidence, [key], negative)
    out = entities.select(*kept).join(fused, key, "left").withColumn(
        "score", F.coalesce("score", F.lit(0.0)))
    return out.withColumn("label", confidence_label("score"))


def with_threshold(entities: DataFrame, cities: DataFrame, countries: DataFrame,
                   default: float = fv.MIN_DISPLAY_SCORE) -> DataFrame:
    """Add the display threshold of each entity's country."""
    dims = cities.select("city_id", "country_code").join(
        countries.select(F.col("code").alias("country_code"), "min_display_score"),
        "country_code", "left").select(
        "city_id", F.coalesce("min_display_score", F.lit(default)).alias("threshold"))
    return entities.join(dims, "city_id", "left").withColumn(
        "threshold", F.coalesce("threshold", F.lit(default)))


def shown(entities: DataFrame, cities: DataFrame, countries: DataFrame,
          default: float = fv.MIN_DISPLAY_SCORE) -> DataFrame:
    """Active entities at or above the threshold of their country."""
    df = with_threshold(entities.where(F.col("status") == "active"), cities, countries, default)
    return df.where(F.col("score") >= F.col("threshold")).drop("threshold")
