"""Similarity join of short names: which pairs can reach a token-set similarity at all.

A pair of similarity ``least`` is alike in one of three ways, each with a part that it must share:

- the words in common make up nearly all of one name (or all of it): then the pair shares one of
  that name's *leading* words, its rarest ones, as many as are too long to be what is left over;
- the whole names are at a small insert/delete distance: then the pair shares many *grams* (a
  letter with the one before it in its word), and so one of the rarest few of either name;
- the name consists of so many one-letter words that no gram is certain: it meets every name.

Rare parts meet first and frequent ones not at all, so a joined key has few names. What meets is
then tested by counts, still in generated code; only what passes is compared letter by letter.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vouch import fixed_values as fv
from vouch.functions.similarity import token_set_ratio
from vouch.operators.spatial import pairs_within, with_cell, with_neighbour_cells

Settle = Callable[[DataFrame], DataFrame]


def _words(name: str) -> Column:
    return F.array_distinct(F.split(name, " "))


def _grams(words: str) -> Column:
    """Every letter with its left neighbour in the word; the n-th of equal grams has the number n."""
    pairs = F.flatten(F.transform(words, lambda w: F.transform(
        F.sequence(F.lit(1), F.length(w)),
        lambda i: F.substring(F.concat(F.lit("\u0001"), w), i, F.lit(2)))))
    return F.transform(F.array_sort(pairs), lambda g, i: F.struct(g.alias("g"), i.alias("i")))


def _tagged(tag: str, values: Column) -> Column:
    return F.transform(values, lambda v: F.concat(F.lit(tag), v))


def _untagged(tag: str) -> Column:
    return F.transform(F.filter("parts", lambda p: p.startswith(tag)),
                       lambda p: F.substring(p, F.lit(2), F.length(p)))


def name_parts(names: DataFrame, least: float = fv.NAME_SIMILARITY_CUT) -> DataFrame:
    """(name, words, grams, size, rare_grams, leading) of each distinct name.

    ``rare_grams`` is null where no gram is certain. Parts are ordered by how many names have
    them: one aggregation over the parts, which are as many as letters."""
    away = 1 - least / 100
    base = names.select("name").where(F.col("name") != "").distinct()
    base = base.select("name", _words("name").alias("words"))
    base = base.select("name", "words", F.length(F.array_join("words", " ")).alias("size"),
                       _grams("words").alias("grams"))
    # equal grams of one name are told apart by their number among them
    numbered = F.transform("grams", lambda x: F.concat(x["g"], (x["i"] - F.array_position(
        F.transform("grams", lambda y: y["g"]), x["g"])).cast("string")))
    base = base.select("name", "words", "size", numbered.alias("grams"))
    parts = base.select("name", F.explode(F.concat(_tagged("g", F.col("grams")),
                                                   _tagged("=", F.col("words")))).alias("part"))
    counts = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    ordered = parts.join(counts, "part").groupBy("name").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("n", "part"))), lambda x: x["part"]).alias("parts"))
    full = base.join(ordered, "name")
    # grams that must be shared with a name of the least favourable length
    ends = [(1 - away) / (1 + away), (1 + away) / (1 - away)]
    lost = max(1.5 * away * (1 + x) + 0.5 * (1 - x) for x in ends)
    sure = F.ceil(F.size("grams") - lost * F.col("size") - 1e-9).cast("int")
    over = F.greatest((away * (2 * F.col("size") - 1) - 1) / (1 + away), F.lit(0.0))
    full = full.withColumns({"_rare": _untagged("g"), "_sure": sure, "_words": _untagged("="),
                             "_over": over})
    return full.select(
        "name", "words", "grams", "size",
        F.when(F.col("_sure") > 0, F.slice("_rare", F.lit(1), F.size("_rare") - F.col("_sure") + 1))
        .alias("rare_grams"),
        F.filter("_words", lambda w, i: F.length(F.array_join(F.slice("_words", F.lit(1), i), " "))
                 <= F.col("_over")).alias("leading"))


def _keys(mine: str, other: str) -> Column:
    """What a name is joined by: ``mine`` and ``other`` tell the two sides apart, so that leading
    words meet all words and a name without a certain gram meets all names."""
    none = F.array().cast("array<string>")
    every = F.when(F.col("rare_grams").isNull(), F.array(F.lit(mine + "*"))).otherwise(none)
    return F.concat(_tagged("g", F.coalesce("rare_grams", none)), _tagged(mine + "=", F.col("leading")),
                    _tagged(other + "=", F.col("words")), every, F.array(F.lit(other + "*")))


def can_be_similar(least: float = fv.NAME_SIMILARITY_CUT) -> Column:
    """Whether words, grams and sizes (those of the right side with ``r_``) allow ``least``."""
    away, c = 1 - least / 100, F.col
    both = F.array_intersect("words", "r_words")
    left = F.length(F.array_join(F.array_except("words", "r_words"), " "))
    right = F.length(F.array_join(F.array_except("r_words", "words"), " "))
    shared = F.length(F.array_join(both, " "))

    def mostly(rest: Column) -> Column:  # the words in common against one whole name
        return (rest == 0) | (1 + rest <= away * (2 * shared + 1 + rest) + 1e-9)

    off, gap = away * (c("size") + c("r_size")), c("size") - c("r_size")
    common = F.size(F.array_intersect("grams", "r_grams"))
    close = (F.abs(gap) <= off + 1e-9) & (
        common >= F.greatest(F.size("grams") - 1.5 * off - 0.5 * gap,
                             F.size("r_grams") - 1.5 * off + 0.5 * gap) - 1e-9)
    return ((F.size(both) > 0) & (mostly(left) | mostly(right))) | close


def candidate_names(left: DataFrame, right: DataFrame, keys: list[str],
                    least: float = fv.NAME_SIMILARITY_CUT, settle: Settle = lambda df: df,
                    ) -> DataFrame:
    """Distinct (name, r_name) with equal ``keys`` that can reach ``least``; a superset of those
    that do. ``left`` has name, ``right`` r_name; a key may hold any number of names. ``settle``
    may store the parts of the names, which are read four times."""
    right = right.withColumnRenamed("r_name", "name")
    p = settle(name_parts(left.select("name").unionByName(right.select("name")), least))
    p = p.select("name", "words", "grams", "size", "rare_grams", "leading")
    a = left.select(*keys, "name").distinct().join(p, "name").select(
        *keys, "name", F.explode(_keys("1", "2")).alias("_key"))
    b = right.select(*keys, "name").distinct().join(p, "name").select(
        *keys, F.col("name").alias("r_name"), F.explode(_keys("2", "1")).alias("_key"))
    met = a.join(b, [*keys, "_key"]).select("name", "r_name").distinct()
    mine = p.select("name", "words", "grams", "size")
    theirs = p.select(*[F.col(x).alias(f"r_{x}") for x in ("name", "words", "grams", "size")])
    return met.join(mine, "name").join(theirs, "r_name").where(can_be_similar(least)).select(
        "name", "r_name")


def similar_names(left: DataFrame, right: DataFrame, keys: list[str],
                  least: float = fv.NAME_SIMILARITY_CUT, settle: Settle = lambda df: df,
                  ) -> DataFrame:
    """(name, r_name, similarity) of the distinct pairs with equal ``keys`` and at least ``least``."""
    found = candidate_names(left, right, keys, least, settle)
    return found.withColumn("similarity", token_set_ratio("name", "r_name")).where(
        F.col("similarity") >= least)


def similar_within(left: DataFrame, right: DataFrame, keys: list[str], meters: float,
                   least: float = fv.NAME_SIMILARITY_CUT, settle: Settle = lambda df: df,
                   ) -> DataFrame:
    """Pairs of located rows with equal ``keys``, at most ``meters`` apart, whose names differ and
    have at least the similarity ``least``. ``left`` has name, lat, lng; ``right`` r_name, r_lat,
    r_lng.

    Names meet by neighbourhood and part, never all with all; places are then joined by cell and
    similar name. Equal names, which may be a third of all rows, are left to ``min_id_within``."""
    near = with_neighbour_cells(left.select(*keys, "name", "lat", "lng").distinct(), meters,
                                lat_lo="lat", lat_hi="lat", lng_lo="lng", lng_hi="lng")
    cells = with_cell(right.select(*keys, "r_name", "r_lat", "r_lng").distinct(), meters,
                      lat="r_lat", lng="r_lng")
    names = similar_names(near, cells, [*keys, "_row", "_col"], least, settle).where(
        F.col("name") != F.col("r_name"))
    return pairs_within(left.join(names, "name"), right, [*keys, "r_name"], meters)
