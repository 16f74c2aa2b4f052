"""Keyed merges, pruning and set operations between table versions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rule = Callable[[Column, Column], Column]


def upsert(target: DataFrame, rows: DataFrame, key: list[str],
           on_update: dict[str, Rule] | None = None) -> DataFrame:
    """Keyed upsert as one full outer join. Columns of ``rows`` replace the target's on
    update; ``on_update`` maps a column to (old, new) -> value. Write the result to a new
    version and swap it in, or use MERGE where the table format offers it."""
    on_update = on_update or {}
    old, new = target.alias("o"), rows.alias("n")
    joined = old.withColumn("_in_o", F.lit(True)).alias("o").join(
        new.withColumn("_in_n", F.lit(True)).alias("n"),
        [F.col(f"o.{k}") == F.col(f"n.{k}") for k in key], "full")
    has_old, has_new = F.col("o._in_o").isNotNull(), F.col("n._in_n").isNotNull()
    out = []
    for c in target.columns:
        if c in key:
            out.append(F.coalesce(f"o.{c}", f"n.{c}").alias(c))
        elif c not in rows.columns:
            out.append(F.col(f"o.{c}").alias(c))
        else:
            replaced = on_update[c](F.col(f"o.{c}"), F.col(f"n.{c}")) if c in on_update else (
                F.col(f"n.{c}"))
            out.append(F.when(has_old & has_new, replaced)
                       .when(has_new, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
    return joined.select(*out)


def keep_switched_off(old: Column, new: Column) -> Column:
    """A flag that somebody turned off stays off after a reload."""
    return old & new


def missing_records(known: DataFrame, seen: DataFrame, group: list[str],
                    ident: str = "external_id") -> DataFrame:
    """Known ids a source no longer lists. A group (source and city) of which nothing was
    seen is not trusted and loses nothing."""
    trusted = seen.select(*group).distinct()
    gone = known.select(*group, ident).join(seen.select(*group, ident), [*group, ident],
                                            "left_anti")
    return gone.join(trusted, group, "left_semi")


def prune(entities: DataFrame, records: DataFrame, evidence: DataFrame, links: DataFrame,
          categories: DataFrame, missing: DataFrame) -> dict[str, DataFrame]:
    """Tables without the missing records and without the entities left with no record."""
    rkey = ["source_id", "external_id"]
    gone = missing.select(*rkey)
    records = records.join(gone, rkey, "left_anti")
    alive = records.select("business_id").distinct()
    return {
        "entities": entities.join(alive, "business_id", "left_semi"),
        "records": records,
        "evidence": evidence.join(gone, rkey, "left_anti").join(alive, "business_id",
                                                                "left_semi"),
        "links": links.join(alive, "business_id", "left_semi"),
        "categories": categories.join(alive, "business_id", "left_semi"),
    }


def replace_evidence(evidence: DataFrame, touched: DataFrame, fresh: DataFrame) -> DataFrame:
    """Evidence with every touched record's rows replaced by the fresh ones. A record that
    is touched without fresh rows ends up empty but stays known."""
    rkey = ["source_id", "external_id"]
    kept = evidence.join(touched.select(*rkey).distinct(), rkey, "left_anti")
    return kept.unionByName(fresh.select(*evidence.columns))


def add_links(links: DataFrame, fresh: DataFrame) -> DataFrame:
    """Links plus the unknown ones among ``fresh``; the first spelling of a link stays."""
    lkey = ["business_id", "kind", "value"]
    new = fresh.select(*links.columns).join(links.select(*lkey), lkey, "left_anti")
    rest = [c for c in links.columns if c not in lkey]
    first = new.groupBy(*lkey).agg(*[F.min(c).alias(c) for c in rest]) if rest else new.distinct()
    return links.unionByName(first.select(*links.columns))


def add_categories(categories: DataFrame, fresh: DataFrame) -> DataFrame:
    """Union of categories per entity in which 'other' gives way to any real one. Semi joins
    only, so an entity with many listings never becomes one group."""
    both = categories.unionByName(fresh.select(*categories.columns)).distinct()
    real = both.where(F.col("slug") != "other").select("business_id").distinct()
    other = both.where(F.col("slug") == "other").join(real, "business_id", "left_anti")
    return both.where(F.col("slug") != "other").unionByName(other)


def distinct_links(links: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """First link per listing, kind and value."""
    from vouch.operators.ranking import first_by

    return first_by(links, [*key, "kind", "value"], order)


def merge_sources(*sources: DataFrame) -> DataFrame:
    """All source streams as one listing table; absent columns become null."""
    out = sources[0]
    for df in sources[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def new_block_entries(removed: DataFrame, links: DataFrame, block_list: DataFrame) -> DataFrame:
    """(kind, value) of removed entities that the block list does not hold yet."""
    theirs = links.join(removed.select("business_id"), "business_id", "left_semi").select(
        "kind", "value").distinct()
    return theirs.join(block_list.select("kind", "value"), ["kind", "value"], "left_anti")


def term_union(first: DataFrame, second: DataFrame) -> DataFrame:
    """Distinct terms of both lists; ``ord`` keeps first appearance, first list first."""
    tagged = first.select("term", F.lit(0).alias("part"), "ord").unionByName(
        second.select("term", F.lit(1).alias("part"), "ord"))
    return tagged.groupBy("term").agg(F.min(F.struct("part", "ord")).alias("ord"))
