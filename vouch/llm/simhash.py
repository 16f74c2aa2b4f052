"""SimHash fingerprints, linked by meeting in the middle: shuffled balls of half the radius."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vouch.llm.common import read, text_slices, words_of
from vouch.llm.components import components
from vouch.llm.mixing import row_hashes
from vouch.operators.lineage import cut

#: Words of a shingle, seed of its hash, differing bits that still link.
SHINGLE, HASH_SEED, RADIUS = 4, 42, 4
#: Bits of the bucket that a variant lies in: the exclusive or of the four quarters of its bits.
FOLD = 16
#: Rows of the shuffle that are expanded at a time, at least (whole buckets).
CHUNK = 1 << 16


def fingerprint(texts: pa.Array) -> np.ndarray:
    """The 64-bit fingerprints of the texts.

    A bit is 1 if it is set in over half the XXH64 hashes of the text's shingles, repeats included
    (fewer words than a shingle has: the whole sequence; no word: fingerprint 0).
    """
    words, counts = words_of(texts)
    out = np.zeros(len(counts), np.uint64)
    if not len(words):
        return out
    blob = memoryview(" ".join(words.to_pylist()).encode())
    lengths = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    shingles = np.where(counts > 0, np.maximum(counts - SHINGLE + 1, 1), 0)
    full = np.flatnonzero(shingles)
    rows = np.cumsum(shingles) - shingles
    firsts = np.repeat(np.cumsum(counts) - counts - rows, shingles) + np.arange(shingles.sum())
    lasts = firsts + np.repeat(np.minimum(counts, SHINGLE), shingles) - 1
    hashed = xxhash.xxh64_intdigest
    hashes = np.fromiter((hashed(blob[a:b], HASH_SEED) for a, b in zip(
        starts[firsts].tolist(), ends[lasts].tolist(), strict=True)), np.uint64, len(firsts))
    step = 1 << 18
    total = np.zeros((len(full), 64), np.int64)
    of_row = np.repeat(np.arange(len(full)), shingles[full])
    for at in range(0, len(hashes), step):
        bits = np.unpackbits(hashes[at:at + step].view(np.uint8).reshape(-1, 8), axis=1,
                             bitorder="little")
        part = of_row[at:at + step]
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1])
        total[part[cuts]] += np.add.reduceat(bits, cuts, axis=0, dtype=np.int64)
    above = total * 2 > shingles[full][:, None]
    out[full] = np.packbits(above, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (default: all) and ``fp long`` (the fingerprint's bits), in one narrow
    pass. Null and empty texts have fingerprint 0."""
    keep = docs.columns if keep is None else keep
    df = docs.select(*[docs[c] for c in keep], docs[text].alias("_text"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch, "_text"):
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array(fingerprint(texts).view(np.int64))],
                    [*part.schema.names[:-1], "fp"])

    return df.mapInArrow(run, ", ".join([*fields, "fp long"]))


def _folded(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    return (x ^ (x >> np.uint64(16))) & np.uint64((1 << FOLD) - 1)


def _ball() -> dict[int, np.ndarray]:
    """All changes of at most half the radius in bits, by the change of the bucket."""
    bits = [1 << k for k in range(64)]
    masks = np.array([sum(c) for n in range(RADIUS // 2 + 1) for c in combinations(bits, n)],
                     np.uint64)
    change = _folded(masks)
    return {int(c): masks[change == c] for c in np.unique(change)}


BALL = _ball()


def _fold_column(fp: Column) -> Column:
    x = fp.bitwiseXOR(F.shiftrightunsigned(fp, 32))
    return x.bitwiseXOR(F.shiftrightunsigned(x, 16)).bitwiseAND((1 << FOLD) - 1).cast("int")


def meet(buckets: np.ndarray, fps: np.ndarray) -> np.ndarray:
    """Pairs (fingerprint, smaller fingerprint) that share a variant in one of the buckets.

    All variants of the fingerprints that lie in the buckets are sorted; those that occur twice
    are met. Each fingerprint at a variant is paired with the smallest one there, which keeps it
    connected to all the others; two that share a variant differ in at most the radius, and the
    difference is counted again for every pair.
    """
    change = (_folded(fps) ^ buckets.astype(np.uint64)).astype(np.int64)
    order = np.argsort(change, kind="stable")
    change, fps = change[order], fps[order]
    cuts = np.flatnonzero(np.diff(change, prepend=-1))
    parts = [(fps[a:b], BALL[int(change[a])]) for a, b in zip(
        cuts, [*cuts[1:], len(fps)], strict=True)]
    variants = np.concatenate([(f[:, None] ^ m[None, :]).ravel() for f, m in parts])
    sources = np.concatenate([np.repeat(f, len(m)) for f, m in parts])
    ordered = np.sort(variants)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.empty((0, 2), np.uint64)
    # a small table of hashes leaves few variants to look up
    key = lambda v: (v * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)
    seen = np.zeros(1 << 20, bool)
    seen[key(twice)] = True
    near = seen[key(variants)]
    variants, sources = variants[near], sources[near]
    at = np.minimum(np.searchsorted(twice, variants), len(twice) - 1)
    hit = twice[at] == variants
    at, sources = at[hit], sources[hit]
    least = np.full(len(twice), np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, at, sources)
    pairs = np.unique(np.stack([sources, least[at]], axis=1), axis=0)
    pairs = pairs[pairs[:, 0] != pairs[:, 1]]
    return pairs[np.bitwise_count(pairs[:, 0] ^ pairs[:, 1]) <= RADIUS]


def links(distinct: DataFrame) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column ``fp``) that differ in at most
    ``RADIUS`` bits; every two that do are connected by edges.

    Every fingerprint stands for its 2081 variants within half the radius. They are shuffled by
    the bucket that they lie in, and a bucket gets the fingerprint once, not each variant: 137
    rows instead of 2081. There the variants are written out and compared. The bucket is a fold of
    all bits, so that the variants of one dense cluster also spread over many buckets.
    """
    changes = F.array(*[F.lit(c) for c in BALL])
    # fingerprints are small and their variants are not: many tasks write them out
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sent = (distinct.repartition(parts, "fp").select("fp", F.explode(changes).alias("_change"))
            .select(_fold_column(F.col("fp")).bitwiseXOR(F.col("_change")).alias("bucket"), "fp")
            .repartition("bucket").sortWithinPartitions("bucket"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            pairs = meet(np.concatenate([p[0] for p in parts]),
                         np.concatenate([p[1] for p in parts])).view(np.int64)
            return pa.RecordBatch.from_arrays(
                [pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])

        held: list[tuple[np.ndarray, np.ndarray]] = []
        rows, enough = 0, CHUNK
        for batch in batches:
            held.append((batch.column(0).to_numpy(zero_copy_only=False),
                         batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)))
            rows += batch.num_rows
            if rows >= enough:
                bucket, fps = (np.concatenate([p[k] for p in held]) for k in (0, 1))
                whole = int(np.searchsorted(bucket, bucket[-1]))  # the last one may go on
                if whole:
                    yield found([(bucket[:whole], fps[:whole])])
                held, rows = [(bucket[whole:], fps[whole:])], len(bucket) - whole
                enough = max(CHUNK, 2 * rows)
        if rows:
            yield found(held)

    return sent.mapInArrow(run, "a long, b long").distinct()


def classes(prints: DataFrame) -> DataFrame:
    """Linked fingerprints only: fp and root (one fingerprint for each connected class)."""
    distinct = cut(prints.select("fp").distinct())
    return components(links(distinct)).select(F.col("node").alias("fp"), "root")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id (the
    smallest doc_id that links reach, itself included).

    Equal fingerprints are one node, so that groups of copies cost one node. Null and empty texts
    share fingerprint 0. A null doc_id counts as no id: it is never the smallest, and a class of
    null ids only has a null component_id.
    """
    prints = cut(fingerprints(docs.select(F.col(doc_id).alias("doc_id"),
                                          F.col(text).alias("text")), keep=["doc_id"]))
    roots = classes(prints)
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    rooted = least.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_print = cut(rooted.join(named, "root").select("fp", "component_id"))
    return prints.join(of_print, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, without all but one document of each class: the one of
    the smallest doc_id (nulls last), then of the smallest hash of the row."""
    hashed = docs.select(*row_hashes(docs), *[F.col(f"`{c}`").alias(f"k_{c}") for c in docs.columns])
    slim = cut(fingerprints(hashed, f"k_{text}", [f"k_{doc_id}", "_row1", "_row2"]).toDF(
        "_id", "_row1", "_row2", "fp"))
    roots = classes(slim)
    first = F.min(F.struct(F.col("_id").isNull().alias("n"), "_id", "_row1", "_row2"))
    least = slim.groupBy("fp").agg(first.alias("_first"))
    kept = (least.join(roots, "fp", "left").groupBy(F.coalesce("root", "fp").alias("root"))
            .agg(F.min("_first").alias("_first")).select("_first._row1", "_first._row2"))
    return (hashed.dropDuplicates(["_row1", "_row2"]).join(kept, ["_row1", "_row2"], "left_semi")
            .select(*[F.col(f"`k_{c}`").alias(c) for c in docs.columns]))


def op9_ball_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of operator 9 for every document."""
    return near_duplicates(read(spark, sf_dir, "documents"))
