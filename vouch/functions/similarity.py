"""Token-set name similarity, 0..100, for candidate pairs that already passed a join."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vouch.functions.text import ColumnOrName, col


def _common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, one machine word operation per character."""
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & masks.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


@F.arrow_udf(T.IntegerType())
def _lcs_rows(left: pa.Array, right: pa.Array) -> pa.Array:
    pairs = zip(left.to_pylist(), right.to_pylist(), strict=True)
    return pa.array([None if a is None or b is None else _common_subsequence(a, b)
                     for a, b in pairs], pa.int32())


def token_set_ratio(left: ColumnOrName, right: ColumnOrName) -> Column:
    """Similarity of two normalised names (words separated by one blank).

    The shared words and the two remainders are compared as in the usual token-set ratio:
    100 when one word set contains the other, else the best of three insert/delete ratios.
    Only pairs that need the remainder distance are sent to the Arrow UDF.
    """
    left, right = col(left), col(right)
    a = F.array_sort(F.array_distinct(F.split(left, " ")))
    b = F.array_sort(F.array_distinct(F.split(right, " ")))
    empty = (F.coalesce(left, F.lit("")) == "") | (F.coalesce(right, F.lit("")) == "")
    both = F.array_intersect(a, b)
    rest_a = F.array_join(F.array_except(a, b), " ")
    rest_b = F.array_join(F.array_except(b, a), " ")
    n_both = F.length(F.array_join(both, " "))
    n_a, n_b = F.length(rest_a), F.length(rest_b)
    contained = (F.size(both) > 0) & ((n_a == 0) | (n_b == 0))
    undecided = ~empty & ~contained
    common = _lcs_rows(F.when(undecided, rest_a), F.when(undecided, rest_b))
    sep = F.when(n_both > 0, 1).otherwise(0)
    total_a, total_b = n_both + sep + n_a, n_both + sep + n_b

    def ratio(distance: Column, total: Column) -> Column:
        return F.when(total > 0, 100.0 - 100.0 * distance / total).otherwise(100.0)

    rests = ratio(n_a + n_b - 2 * common, total_a + total_b)
    with_a = F.when(n_both > 0, ratio(sep + n_a, n_both + total_a)).otherwise(0.0)
    with_b = F.when(n_both > 0, ratio(sep + n_b, n_both + total_b)).otherwise(0.0)
    return (
        F.when(empty, F.lit(0.0))
        .when(contained, F.lit(100.0))
        .otherwise(F.greatest(rests, with_a, with_b))
    )


def token_set_ratio_of(left: str, right: str) -> float:
    """The same similarity for two names inside a task."""
    if not left or not right:
        return 0.0
    a, b = sorted(set(left.split(" "))), sorted(set(right.split(" ")))
    both = [w for w in a if w in b]
    rest_a, rest_b = (" ".join(w for w in x if w not in both) for x in (a, b))
    if both and not (rest_a and rest_b):
        return 100.0
    shared, sep = len(" ".join(both)), 1 if both else 0
    total_a, total_b = shared + sep + len(rest_a), shared + sep + len(rest_b)
    apart = len(rest_a) + len(rest_b) - 2 * _common_subsequence(rest_a, rest_b)
    best = 100.0 - 100.0 * apart / (total_a + total_b)
    for rest, total in ((rest_a, total_a), (rest_b, total_b)) if both else ():
        best = max(best, 100.0 - 100.0 * (sep + len(rest)) / (shared + total))
    return best
