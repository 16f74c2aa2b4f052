"""Near-duplicate vectors by cosine: tiles in the order of principal axes, stopped early."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vouch.llm.common import read
from vouch.llm.components import components
from vouch.operators.lineage import cut

COSINE = 0.95
#: Vectors that the axes are fitted on, at most; axes only change the speed, never the result.
FIT_ROWS = 8192
#: A task compares two groups of at most about GROUP_ROWS vectors, in tiles of TILE rows;
#: LEAST_GROUPS keep small tables parallel.
GROUP_ROWS, TILE, LEAST_GROUPS = 16_384, 1024, 16
#: Dimensions added at a time, and the part of a tile's pairs below which pairs go on one by one.
BLOCK, FEW = 16, 0.05
#: Room for rounding in the bounds; the decision itself is the full product.
SLACK = 1e-9


def unit(raw: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision (first by the largest component, so that no
    square overflows or vanishes)."""
    x = raw.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def axes(sample: np.ndarray) -> np.ndarray:
    """Principal axes of unit vectors as columns, the one with the most energy first. The rotation
    keeps every product."""
    _, vectors = np.linalg.eigh(sample.T @ sample)
    return vectors[:, ::-1]


class Side:
    """The vectors of one group: unit vectors, rotated ones, suffix norms, in order of the first
    axis."""

    def __init__(self, raw: np.ndarray, rotation: np.ndarray | None):
        self.unit = unit(raw)
        turned = self.unit if rotation is None or len(rotation) != raw.shape[1] \
            else self.unit @ rotation
        self.order = np.argsort(turned[:, 0], kind="stable")
        self.unit, self.turned = self.unit[self.order], turned[self.order]
        squares = np.cumsum((self.turned ** 2)[:, ::-1], axis=1)[:, ::-1]
        # rest[k]: length of what dimensions from k on hold
        self.rest = np.sqrt(np.concatenate([squares, np.zeros((len(raw), 1))], axis=1))

    def tiles(self) -> Iterator[slice]:
        return (slice(a, min(a + TILE, len(self.order))) for a in range(0, len(self.order), TILE))


def tile_pairs(a: Side, b: Side, of_a: slice, of_b: slice, cosine: float,
               ) -> tuple[np.ndarray, np.ndarray]:
    """Positions (in the order of the sides) of all pairs of two tiles with at least ``cosine``.

    Leading dimensions are added in blocks; after each, what is missing is at most the product of
    the suffix norms, and pairs that cannot reach the threshold any more stop.
    """
    ta, tb, ra, rb = a.turned[of_a], b.turned[of_b], a.rest[of_a], b.rest[of_b]
    dims = ta.shape[1]
    low = cosine - SLACK
    # unit vectors with this cosine are no further apart than this along any axis
    reach = np.sqrt(max(2 - 2 * low, 0))
    if ta[0, 0] - tb[-1, 0] > reach or tb[0, 0] - ta[-1, 0] > reach:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at, sums = 0, np.zeros((len(ta), len(tb)))
    while True:
        to = min(at + BLOCK, dims)
        sums += ta[:, at:to] @ tb[:, at:to].T
        at = to
        open_ = sums >= low - ra[:, at][:, None] * rb[:, at][None, :]
        if at == dims or np.count_nonzero(open_) <= FEW * open_.size:
            break
    i, j = np.nonzero(open_)
    part = sums[i, j]
    while at < dims and len(i):
        to = min(at + BLOCK, dims)
        part = part + np.einsum("ij,ij->i", ta[i, at:to], tb[j, at:to])
        at = to
        on = part >= low - ra[i, at] * rb[j, at]
        i, j, part = i[on], j[on], part[on]
    i, j = i + of_a.start, j + of_b.start
    full = np.concatenate([np.empty(0)] + [
        np.einsum("ij,ij->i", a.unit[i[k:k + 65536]], b.unit[j[k:k + 65536]])
        for k in range(0, len(i), 65536)])
    return i[full >= cosine], j[full >= cosine]


def join_labels(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Make the labels of linked rows the smallest one of their class, in place."""
    while True:
        x, y = labels[i], labels[j]
        if np.array_equal(x, y):
            return
        least = np.minimum(x, y)
        np.minimum.at(labels, x, least)
        np.minimum.at(labels, y, least)
        while True:
            up = labels[labels]
            if np.array_equal(up, labels):
                break
            labels[:] = up


def compare(keys: np.ndarray, copies: np.ndarray, raw: np.ndarray, second: np.ndarray | None,
            rotation: np.ndarray | None, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Compare the rows of two groups with each other (``second``: which rows are of the second
    group), or, with None, those of one group among themselves.

    Returns for each row with a link its key, the copies that it links to here, and the key of a
    row that stands for its class here. Pairs never leave the tile.
    """
    first = np.arange(len(keys)) if second is None else np.flatnonzero(~second)
    other = first if second is None else np.flatnonzero(second)
    none = np.empty(0, np.int64)
    if not len(first) or not len(other):
        return none, none, none
    a = Side(raw[first], rotation)
    b = a if second is None else Side(raw[other], rotation)
    at_a, at_b = first[a.order], other[b.order]
    links, labels = np.zeros(len(keys), np.int64), np.arange(len(keys))
    for of_a in a.tiles():
        for of_b in b.tiles():
            if second is None and of_b.start < of_a.start:
                continue
            i, j = tile_pairs(a, b, of_a, of_b, cosine)
            i, j = at_a[i], at_b[j]
            if second is None and of_a == of_b:
                once = i < j
                i, j = i[once], j[once]
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            join_labels(labels, i, j)
    hit = np.flatnonzero(links)
    return keys[hit], links[hit], keys[labels[hit]]


def usable(vector: str) -> Column:
    return F.expr(f"vec_id IS NOT NULL AND `{vector}` IS NOT NULL AND "
                  f"exists(`{vector}`, x -> x <> 0) AND NOT exists(`{vector}`, x -> x IS NULL OR "
                  "isnan(x) OR abs(x) = double('infinity'))")


def vector_links(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding",
                 cosine: float = COSINE) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links (other rows linked directly),
    component_id (smallest vec_id that links reach, itself included), kept.

    Vectors that are null, empty, zero or hold null or non-finite numbers, rows without vec_id,
    and vectors of different length link with nothing. Equal vectors are folded to one with a
    count first. The distinct vectors are dealt by a hash into groups of bounded size, so that no
    dense region is one task, and every two groups meet in one task. That is every pair once:
    the work grows with the square of the distinct vectors, each pair stopping after about BLOCK
    dimensions; what tasks return is one row per linked vector, never pairs. All results are
    exact: the axes, fitted on a bounded sample, only order the dimensions.
    """
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("vector"))
    good = rows.where(usable("vector"))
    folded = cut(good.groupBy("vector").agg(F.count(F.lit(1)).alias("copies"),
                                            F.min("vec_id").alias("least"))
                 .withColumn("key", F.monotonically_increasing_id())
                 .withColumn("hash", F.xxhash64("vector")))
    n = folded.count()
    sample = [r[0] for r in folded.orderBy("hash", "key").limit(FIT_ROWS).select("vector").collect()]
    dims = max((len(v) for v in sample), default=0)
    fitted = [v for v in sample if len(v) == dims]
    rotation = axes(unit(np.array(fitted))) if fitted else None
    groups = max(LEAST_GROUPS, -(-n // GROUP_ROWS))
    single = dict(rows.dtypes)["vector"] == "array<float>"
    dtype = np.dtype(np.float32 if single else np.float64)
    wide = "vector" if single else "CAST(vector AS array<double>)"
    own = F.pmod("hash", F.lit(groups)).cast("int")
    dealt = (folded.select("key", "copies", F.expr(wide).alias("vector"), own.alias("own"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
             .select(F.least("own", "other").alias("g"), F.greatest("own", "other").alias("h"),
                     F.size("vector").alias("dims"), "own", "key", "copies", "vector"))
    shared = vectors.sparkSession.sparkContext.broadcast(rotation)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        g, h = key[0].as_py(), key[1].as_py()
        flat = table.column("vector").combine_chunks().flatten()
        raw = flat.to_numpy(zero_copy_only=False).astype(dtype).reshape(table.num_rows, -1)
        keys, copies, own = (table.column(c).to_numpy() for c in ("key", "copies", "own"))
        found = compare(keys, copies, raw, None if g == h else own == h, shared.value, cosine)
        return pa.table(dict(zip(("key", "links", "root"), map(pa.array, found), strict=True)))

    met = cut(dealt.groupBy("g", "h", "dims").applyInArrow(run, "key long, links long, root long"))
    links = met.groupBy("key").agg(F.sum("links").alias("links"))
    roots = components(met, "key", "root").withColumnRenamed("node", "key")
    named = (folded.join(links, "key", "left").join(roots, "key", "left")
             .withColumn("root", F.coalesce("root", "key")))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of_vector = named.join(least, "root").select(
        F.col("vector").alias("_v"), "component_id",
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    linked = good.join(of_vector, F.col("vector") == F.col("_v")).select(
        "vec_id", "n_links", "component_id")
    alone = rows.where(~F.coalesce(usable("vector"), F.lit(False))).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op5_pca_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of operator 5 for every row of ``embeddings``."""
    return vector_links(read(spark, sf_dir, "embeddings"))
