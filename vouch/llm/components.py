"""Connected components of a graph given as edges, by alternating stars in joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vouch.operators.lineage import cut


def _mark(edges: DataFrame) -> tuple:
    """Number and hash sum of the edges: equal marks, equal edge sets."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
                 .first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Links each larger neighbour of a node to the smallest one around the node, a row for each
    edge at most."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return (both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .where("a <> b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the smallest of them. Edges have a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """One row per linked node: node, root (the smallest node that it reaches).

    ``edges`` has two columns of one orderable type, in any direction, repeats and loops allowed;
    rows with a null are left out. Every round is two joins on node keys; its edges are
    checkpointed, and only their number and hash sum come to the driver. The rounds end when the
    edges stay the same, after about the logarithm of the longest path; no bound is set. A node
    with very many neighbours is a skewed join key, which Spark splits; minima combine map-side.
    """
    now = cut(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
              .where(F.col(a).isNotNull() & F.col(b).isNotNull()).where("a <> b").distinct())
    mark = _mark(now)
    while mark[0]:
        now = cut(_small_star(_large_star(now)))
        last, mark = mark, _mark(now)
        if mark == last:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
