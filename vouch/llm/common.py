"""Helpers shared by the operators: reading, slicing Arrow batches, words, digests, prefix sums."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Bytes of text that one step of a Python worker holds at a time; a longer text is a step alone.
SLICE_BYTES = 4 << 20
#: A word of the contracts: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def prefixed(docs: DataFrame) -> DataFrame:
    """All columns as ``k_<name>``, so that none clashes with what an operator adds."""
    return docs.select(*[F.col(f"`{c}`").alias(f"k_{c}") for c in docs.columns])


def text_slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES,
                ) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Consecutive parts of ``batch`` of about ``most`` bytes of text, with the text column
    (null: empty)."""
    texts = pc.fill_null(batch.column(batch.schema.get_field_index(column)), "")
    if not len(texts):
        return
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(texts):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most, "right")))
        yield batch.slice(start, stop - start), texts.slice(start, stop - start)
        start = stop
    pa.default_memory_pool().release_unused()


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts, A-Z lower-cased, one after the other, and each text's number."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat = split.flatten()
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(full)])
    lengths = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    counts = ends[bounds[1:]] - ends[bounds[:-1]]
    return flat.filter(pa.array(full.astype(bool))), counts


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in one array, and the start of each (and the end)."""
    joined = pa.concat_arrays([texts.cast(pa.large_binary())])
    lengths = pc.binary_length(joined).to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths)])
    buffers = joined.buffers()
    first = np.frombuffer(buffers[1], np.int64)[joined.offset] if len(joined) else 0
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.empty(0, np.uint8)
    return data[first:first + starts[-1]], starts


def fold(doc_ids: list[int | None], of: int) -> np.ndarray:
    """crc32(doc_id as text) mod ``of``; -1 for a null id, which belongs to no fold."""
    return np.array([-1 if d is None else zlib.crc32(str(d).encode()) % of for d in doc_ids],
                    dtype=np.int64)


def in_fold(doc_id: Column, of: int, number: int) -> Column:
    """The same in Spark: true where the row's fold is ``number`` (null id: false)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % of == number, F.lit(False))


def digest(text: Column) -> list[Column]:
    """Two 64-bit hashes that stand for a text (equal texts, equal pair; null: empty)."""
    text = F.coalesce(text, F.lit(""))
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit("second"), text).alias("t2")]


def running_sum(df: DataFrame, group: list[str], order: list[str], value: str, out: str,
                cut) -> DataFrame:
    """``out``: the sum of ``value`` over all rows of the group up to and including this one.

    Rows are dealt by range of (group, order), so that a group of any size lies in as many
    partitions as it fills; inside a partition a window sums, and the totals of the earlier
    partitions (one row per partition and group) are added. ``cut`` fixes the dealt rows
    (a checkpoint), because the two reads must see the same partitions.
    """
    keys = [F.col(c).asc_nulls_last() for c in [*group, *order]]
    dealt = cut(df.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy("_part", *group).orderBy(*[F.col(c).asc_nulls_last() for c in order])
    totals = dealt.groupBy("_part", *group).agg(F.sum(value).alias("_total"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_part", *group, F.coalesce(F.sum("_total").over(before),
                                                         F.lit(0)).alias("_before"))
    summed = dealt.withColumn("_inside", F.sum(value).over(
        inside.rowsBetween(Window.unboundedPreceding, 0)))
    left, right = summed.alias("l"), offsets.alias("r")
    on = F.col("l._part") == F.col("r._part")
    for c in group:
        on &= F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    kept = [F.col(f"l.{c}").alias(c) for c in summed.columns if c not in ("_part", "_inside")]
    return left.join(right, on).select(
        *kept, (F.col("l._inside") + F.col("r._before")).alias(out))
