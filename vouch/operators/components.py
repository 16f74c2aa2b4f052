"""Connected components of rows that share groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vouch.operators.lineage import cut


def connected(members: DataFrame, most_rounds: int | None = None) -> DataFrame:
    """(node, root) of every node of ``members`` (node, grp); root is the smallest node reachable
    through shared groups.

    A round takes the least label of each group and of each node's groups, hands it to the root of
    the node's tree and halves the ways to the roots by pointer doubling. Trees merge as whole, so
    the rounds grow with the logarithm of the longest chain, whatever the order of its nodes. All
    minima combine before they are shuffled; a group or root may hold any share of the rows.
    """
    members = members.select("node", "grp").distinct()
    shared = members.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("grp")
    labels = members.select("node").distinct().withColumn("root", F.col("node"))
    members = cut(members.join(shared, "grp"))
    rounds = 0
    while True:
        least = members.join(labels, "node").groupBy("grp").agg(F.min("root").alias("least"))
        seen = members.join(least, "grp").groupBy("node").agg(F.min("least").alias("least"))
        seen = cut(labels.join(seen, "node", "left").select(
            "node", "root", F.coalesce("least", "root").alias("least")))
        if seen.where("least < root").isEmpty():
            return seen.select("node", "root")
        # the root of a tree takes the least label that any of its nodes has seen
        hooked = seen.groupBy(F.col("root").alias("_root")).agg(F.min("least").alias("_least"))
        moved = seen.join(hooked, F.col("root") == F.col("_root")).select(
            "node", F.least("least", "_least").alias("root"))
        up = moved.select(F.col("node").alias("_node"), F.col("root").alias("_up"))
        labels = cut(moved.join(up, F.col("root") == F.col("_node")).select(
            "node", F.col("_up").alias("root")))
        rounds += 1
        if most_rounds is not None and rounds > most_rounds:
            raise RuntimeError(f"not settled in {most_rounds} rounds")
