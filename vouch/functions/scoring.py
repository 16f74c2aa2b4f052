"""Confidence columns and closed-form statistics."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from vouch import fixed_values as fv
from vouch.functions.text import ColumnOrName, col


def settle(value: ColumnOrName, digits: int) -> Column:
    """Round half up after removing the noise of floating-point order (9 digits)."""
    return F.round(F.round(col(value), 9), digits)


def damped(product: Column, has_negative: Column) -> Column:
    """Noisy-OR from the product of the complements, damped once by negative evidence."""
    factor = 1 - fv.SIGNAL_WEIGHTS[fv.NEGATIVE_SIGNAL]
    value = 1 - F.coalesce(product, F.lit(1.0))
    return settle(F.when(has_negative, value * factor).otherwise(value), 4)


def confidence_label(score: ColumnOrName, cuts: Mapping[str, float] = fv.LEVEL_CUTS) -> Column:
    score = col(score)
    chain = None
    for level, cut in sorted(cuts.items(), key=lambda kv: -kv[1]):
        chain = (F if chain is None else chain).when(score >= cut, level)
    return chain


def min_confidence(level: str, threshold: ColumnOrName | None = None) -> Column:
    """The lowest score a search for this level shows."""
    cut = F.lit(fv.LEVEL_CUTS[level])
    return cut if threshold is None else F.greatest(cut, col(threshold))


def wilson(hits: ColumnOrName, total: ColumnOrName, z: float = 1.96) -> tuple[Column, Column]:
    """95 % Wilson interval; (0, 0) when nothing was counted."""
    k, n = col(hits).cast("double"), col(total).cast("double")
    p = k / n
    denominator = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / denominator
    margin = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / denominator
    some = n > 0
    return (F.when(some, F.greatest(centre - margin, F.lit(0.0))).otherwise(0.0),
            F.when(some, F.least(centre + margin, F.lit(1.0))).otherwise(0.0))
