"""Mixing sources to target weights by systematic sampling, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vouch.llm.common import WORD, read, running_sum
from vouch.operators.lineage import cut

#: Weights of the sources in the order of their names, repeating; share of all words that the mix
#: takes; most times that a source may be taken.
WEIGHTS, SHARE, MOST_TIMES = (5, 2, 1), 1.5, 2
#: Expected copies are whole multiples of 1 / UNIT, so that their sums are exact in any order
#: and reruns agree; a source may have 2**31 documents before a sum could overflow.
UNIT = 1 << 31
SEED = 42


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE,
                   most_times: int = MOST_TIMES) -> DataFrame:
    """One row per source: source, source_size, target.

    ``sizes`` has source and source_size, one row per source. Targets share ``share`` times all
    words by weight, none above ``most_times`` its size. Sorted by size per weight, the sources
    that reach the limit stand first; the first source whose share of what is left stays below
    the limit sets the level for all that follow. Two windows over the source list, which is a
    dimension of the mix (one row per source, never per document).
    """
    name = [F.col("source").isNull(), F.col("source").cast("binary")]
    n = len(weights)
    rank = F.row_number().over(Window.orderBy(*name)) - 1
    weighed = sizes.withColumn("_w", F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]), (rank % n + 1).cast("int")))
    limit = F.col("source_size") * F.lit(most_times)
    order = Window.orderBy(limit / F.col("_w"), *name)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.rowsBetween(Window.unboundedPreceding,
                                                         Window.unboundedFollowing))
    # the level if this source and all later ones stay below the limit
    level = (F.lit(share) * total - F.coalesce(F.sum(limit).over(before), F.lit(0))) \
        / F.sum("_w").over(after)
    leveled = weighed.withColumn("_level", level)
    holds = F.col("_level") * F.col("_w") <= limit
    found = leveled.withColumn("_at", F.min(F.when(
        holds, F.struct((limit / F.col("_w")).alias("k"), F.col("_level").alias("level"))))
        .over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return found.select("source", "source_size", F.least(
        limit.cast("double"), F.coalesce(F.col("_at.level") * F.col("_w"), limit.cast("double")))
        .alias("target"))


def offset(source: Column, seed: int = SEED) -> Column:
    """The random start of a source, in units of 1 / UNIT of a copy: from its name and the seed."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(source, F.lit("\0null")))
    return F.conv(F.substring(F.md5(named.cast("binary")), 1, 7), 16, 10).cast("long") * 8


def copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
           weights=WEIGHTS, share: float = SHARE, most_times: int = MOST_TIMES,
           seed: int = SEED) -> DataFrame:
    """One row per distinct row of ``docs``: source, doc_id, _row1, _row2 (hashes of all its
    columns), size, source_size, target, n (times it stands in ``docs``), each (expected copies of
    one, in 1 / UNIT) and _before (offset and expected copies before it).

    The documents of a source stand in the order of size, doc_id and row hash. Neighbours are of
    like size, so the words taken differ from the target by little more than one long document.
    """
    rows = docs.select(
        F.col(source).alias("source"), F.col(doc_id).alias("doc_id"), *row_hashes(docs),
        word_count(F.col(text)).alias("size"))
    rows = cut(rows.groupBy("source", "doc_id", "_row1", "_row2", "size")
               .agg(F.count(F.lit(1)).alias("n")))
    sizes = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    targets = source_targets(sizes, weights, share, most_times).withColumn(
        "each", F.coalesce(F.round(F.col("target") / F.nullif(F.col("source_size"), F.lit(0))
                                   * UNIT), F.lit(0)).cast("long"))
    left, right = rows.alias("l"), targets.alias("r")
    valued = (left.join(right, F.col("l.source").eqNullSafe(F.col("r.source")))
              .select("l.*", "r.source_size", "r.target", "r.each")
              .withColumn("_value", F.col("each") * F.col("n")))
    summed = running_sum(valued, ["source"], ["size", "doc_id", "_row1", "_row2"],
                         "_value", "_after", cut)
    return summed.withColumn("_before", offset(F.col("source"), seed)
                             + F.col("_after") - F.col("_value")).drop("_after", "_value")


def row_hashes(docs: DataFrame) -> list[Column]:
    every = [F.col(f"`{c}`") for c in docs.columns]
    # nulls leave a hash as it is, so which columns are null is hashed too
    nulls = F.concat(*[F.col(f"`{c}`").isNull().cast("int").cast("string") for c in docs.columns])
    return [F.xxhash64(nulls, *every).alias("_row1"),
            F.xxhash64(F.lit("second"), nulls, *every).alias("_row2")]


def boundaries(start: Column, length: Column) -> Column:
    """Whole numbers of copies crossed on the way from ``start``, in units of 1 / UNIT."""
    # the offset keeps every value positive, so the shift is a floor
    return F.shiftright(start + length, 31) - F.shiftright(start, 31)


def taken(docs: DataFrame, **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, copies and taken
    (words that the mix takes of it)."""
    found = copies(docs, **options)
    each = found.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    counted = each.withColumn("copies", boundaries(
        F.col("_before") + F.col("_k") * F.col("each"), F.col("each")))
    return counted.select("doc_id", "source", "size", "source_size", "target", "copies",
                          (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every row of ``docs`` as many times as it is taken, same columns.

    Rows that are alike in all columns are one row with a count, so no row is numbered. A null
    source is a source of its own, the last; a null or empty text has size 0 and is taken like any
    other; a table without words takes nothing. Extra columns pass through.
    """
    found = copies(docs, **options).select("_row1", "_row2", boundaries(
        F.col("_before"), F.col("n") * F.col("each")).cast("int").alias("_copies"))
    hashed = docs.select(*row_hashes(docs), *[F.col(f"`{c}`").alias(f"k_{c}") for c in docs.columns])
    hashed = hashed.dropDuplicates(["_row1", "_row2"])
    joined = hashed.join(found.where("_copies > 0"), ["_row1", "_row2"])
    return (joined.withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
            .select(*[F.col(f"`k_{c}`").alias(c) for c in docs.columns]))


def op8_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of operator 8: doc_id, size, source_size, target and taken of every document."""
    return taken(read(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken")


OP8_SQL = r"""
WITH docs AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size
  FROM documents),
sized AS (SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source),
weighed AS (
  SELECT *, (CASE (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3
             WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END)::DOUBLE AS w,
         sum(source_size) OVER () AS total
  FROM sized),
leveled AS (
  SELECT *, 2 * source_size / w AS k,
    (1.5::DOUBLE * total - coalesce(sum(2 * source_size) OVER (
       ORDER BY 2 * source_size / w, source IS NULL, encode(source)
       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (
       ORDER BY 2 * source_size / w, source IS NULL, encode(source)
       ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
filled AS (SELECT level FROM leveled WHERE level * w <= 2 * source_size ORDER BY k, level LIMIT 1),
targets AS (
  SELECT source, source_size,
    least((2 * source_size)::DOUBLE, coalesce((SELECT level FROM filled) * w,
          (2 * source_size)::DOUBLE)) AS target
  FROM leveled),
each AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0
            ELSE round(target / source_size * 2147483648)::BIGINT END AS e,
    ('0x' || substr(md5('42:' || coalesce(source, chr(0) || 'null')), 1, 7))::BIGINT * 8 AS u
  FROM targets),
placed AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.e,
    t.u + (row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id NULLS LAST) - 1)
          * t.e AS start
  FROM docs d JOIN each t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (size * ((start + e) // 2147483648 - start // 2147483648))::BIGINT AS taken
FROM placed
"""
