"""Near copies by five-word shingles and Jaccard similarity, met by balls of short fingerprints.

The stage of the pipeline. Operator 9's contract (``simhash.py``) fixes one fingerprint of 64 sign
bits, which copies of similarity 0.8 do not share within 4 bits. Here a document has ``PRINTS``
fingerprints of 32 bits. A bit is one bit of the least of the shingles' hashes, so that it differs
with probability (1 - J) / 2 between sets of similarity J; sign bits of the same sets differ more
often (0.15 instead of 0.10 at J = 0.8) and would need over twice as many fingerprints. Two
documents meet if one of their fingerprints differs in at most ``RADIUS`` bits: at J = 0.8 that is
97 of 100 pairs, at 0.85 more than 999 of 1000. Pairs that meet are compared by all bits, then by
their whole shingle sets; only the sets decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vouch.llm.common import text_slices, words_of
from vouch.llm.components import components
from vouch.llm.mixing import row_hashes
from vouch.operators.lineage import cut

#: Words of a shingle and the similarity from which on two documents are near copies.
SHINGLE, SIMILARITY = 5, 0.8
#: Fingerprints of a document, bits of one, and differing bits within which two of them meet.
PRINTS, BITS, RADIUS = 8, 32, 2
#: Of all bits of two documents, the most that may differ before the sets are compared. A pair of
#: similarity 0.8 differs in 26 of 256, with a standard deviation of 5.
MOST_APART = PRINTS * BITS // 4
#: Rows that are expanded at a time, at least (whole buckets).
CHUNK = 1 << 18
#: Pairs left to compare, as a multiple of the memberships, below which they are all written out.
FEW = 4
#: Times that ``crowds`` counts a pair, about: from both sides, and at two variants.
COUNTED = 4

_ODD = np.random.default_rng(42).integers(0, 1 << 63, PRINTS * BITS, np.uint64) * np.uint64(2) + np.uint64(1)
_SKETCH = [f"s{i}" for i in range(PRINTS * BITS // 64)]


def _mixed(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all shingles of the texts one after the other (repeats included), the number of
    each text, and a hash of each text's word sequence (0 for a text without words).

    A text of fewer words than a shingle has one shingle, the whole sequence.
    """
    words, counts = words_of(texts)
    sequence = np.zeros(len(counts), np.uint64)
    numbers = np.where(counts > 0, np.maximum(counts - SHINGLE + 1, 1), 0)
    if not len(words):
        return np.empty(0, np.uint64), numbers, sequence
    coded = words.dictionary_encode()
    each = np.fromiter((xxhash.xxh64_intdigest(w.encode()) for w in coded.dictionary.to_pylist()),
                       np.uint64, len(coded.dictionary))
    hashes = each[coded.indices.to_numpy(zero_copy_only=False)]
    firsts = np.cumsum(counts) - counts
    full = counts > 0
    place = (np.arange(len(hashes)) - np.repeat(firsts, counts)).astype(np.uint64)
    summed = np.add.reduceat(_mixed(hashes + place * np.uint64(0x9E3779B97F4A7C15)), firsts[full])
    sequence[full] = _mixed(summed + counts[full].astype(np.uint64))
    starts = np.repeat(firsts - (np.cumsum(numbers) - numbers), numbers) + np.arange(numbers.sum())
    length = np.repeat(np.minimum(counts, SHINGLE), numbers)
    out = length.astype(np.uint64)
    for k in range(SHINGLE):
        inside = k < length
        out[inside] = _mixed(out[inside] * np.uint64(31) + hashes[starts[inside] + k])
    return out, numbers, sequence


def sketch(shingles: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """All bits of the texts' fingerprints, four 64-bit words each (no shingle: zeros)."""
    out = np.zeros((len(numbers), len(_SKETCH)), np.uint64)
    full = np.flatnonzero(numbers)
    if len(full):
        cuts = (np.cumsum(numbers) - numbers)[full]
        held = np.empty_like(shingles)
        for k, odd in enumerate(_ODD):
            least = np.minimum.reduceat(np.multiply(shingles, odd, out=held), cuts)
            out[full, k // 64] |= ((least >> np.uint64(20)) & np.uint64(1)) << np.uint64(k % 64)
    return out


def _sketched(rows: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """``keep``, node (hash of the word sequence) and the sketch of every row."""
    df = rows.select(*keep, F.col(text).alias("_text"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch, "_text"):
                shingles, numbers, node = shingles_of(texts)
                bits = sketch(shingles, numbers).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array(node.view(np.int64)),
                     *[pa.array(bits[:, i].copy()) for i in range(len(_SKETCH))]],
                    [*part.schema.names[:-1], "node", *_SKETCH])

    return df.mapInArrow(run, ", ".join([*fields, "node long", *[f"{s} long" for s in _SKETCH]]))


def _shingle_sets(rows: DataFrame, text: str) -> DataFrame:
    """node and its distinct shingles, for rows of (node, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch, "_text"):
                shingles, numbers, _ = shingles_of(texts)
                sets = [np.unique(s) for s in np.split(shingles, np.cumsum(numbers)[:-1])]
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.ListArray.from_arrays(
                        ends, np.concatenate(sets).view(np.int64))], ["node", "shingles"])

    return rows.select("node", F.col(text).alias("_text")).mapInArrow(
        run, "node long, shingles array<long>")


def print_columns() -> Column:
    """The fingerprints of a sketch: the number of each in front of its 32 bits."""
    half = lambda k: F.shiftrightunsigned(F.col(_SKETCH[k // 2]), 32 * (k % 2))
    return F.array(*[half(k).bitwiseAND(F.lit((1 << BITS) - 1)).bitwiseOR(F.lit(k << BITS))
                     for k in range(PRINTS)])


def _variants(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The variants (no bit or one bit changed) of the fingerprints of ``rows`` that lie in the rows'
    buckets, in order, with their fingerprints and the places of their rows.

    A row holds a fingerprint's number, the bucket and the fingerprint's bits.
    """
    low = np.uint64((1 << BITS) - 1)
    print_, number = rows & low, rows >> np.uint64(BITS + 16)
    bucket = (rows >> np.uint64(BITS)) & np.uint64(0xFFFF)
    change = bucket ^ (print_ & np.uint64(0xFFFF)) ^ (print_ >> np.uint64(16))
    near = np.flatnonzero(change > 0)
    base = (number << np.uint64(BITS)) | print_
    variants = np.concatenate([base ^ change, base[near] ^ (change[near] << np.uint64(16))])
    at = np.concatenate([np.arange(len(rows)), near])
    sources = base[at]
    order = np.lexsort((sources, variants))
    return variants[order], sources[order], at[order]


def meet(rows: np.ndarray, labels: np.ndarray, low: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Pairs (smaller, larger) of fingerprints that share a variant in the buckets of ``rows``, but
    for pairs of one label (0: none) and those whose sizes do not admit each other: each one's
    least size ``low`` is to be at most what the other admits.

    A variant has at most 33 different fingerprints, so that all their pairs are few.
    """
    variants, sources, at = _variants(rows)
    labels, low, most = labels[at], low[at], most[at]
    found = []
    for d in range(1, len(variants)):
        same = variants[d:] == variants[:-d]
        if not same.any():
            break
        same &= (labels[d:] != labels[:-d]) | (labels[d:] == 0)
        same &= (low[d:] <= most[:-d]) & (low[:-d] <= most[d:])
        found.append(np.stack([sources[:-d][same], sources[d:][same]], axis=1))
    pairs = np.concatenate(found) if found else np.empty((0, 2), np.uint64)
    return np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0)


def crowd(rows: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Fingerprints that share a variant in the buckets of ``rows`` with one of another label or of
    none (0), and the number of others there, a row for each such variant."""
    variants, sources, at = _variants(rows)
    labels = labels[at]
    if not len(variants):
        return np.empty((0, 2), np.uint64)
    starts = np.flatnonzero(np.concatenate([[True], variants[1:] != variants[:-1]]))
    numbers = np.diff(np.append(starts, len(variants)))
    one = (np.minimum.reduceat(labels, starts) == np.maximum.reduceat(labels, starts)) & (labels[starts] != 0)
    some = np.repeat((numbers > 1) & ~one, numbers)
    return np.stack([sources[some], np.repeat(numbers - 1, numbers)[some].astype(np.uint64)], axis=1)


def _in_buckets(prints: DataFrame, more: list[str], work, names: list[str]) -> DataFrame:
    """Rows (long columns ``names``) that ``work`` finds in whole buckets of the fingerprints
    (``grp``), given their rows and the long columns ``more``.

    Each fingerprint stands for its 33 variants within half the radius. They are shuffled by number
    and fold (exclusive or of the halves), which takes 17 rows instead of 33, one long each.
    """
    g = F.col("grp")
    fold = g.bitwiseXOR(F.shiftrightunsigned(g, 16)).bitwiseAND(F.lit(0xFFFF))
    changes = F.array(*[F.lit(c) for c in [0, *[1 << j for j in range(16)]]])
    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    row = (F.shiftleft(F.shiftrightunsigned(g, BITS), BITS + 16)
           .bitwiseOR(F.shiftleft(fold.bitwiseXOR(F.col("_c").cast("long")), BITS))
           .bitwiseOR(g.bitwiseAND(F.lit((1 << BITS) - 1))))
    sent = (prints.select("grp", *more, F.explode(changes).alias("_c")).select(row.alias("row"), *more)
            .repartition(parts, F.shiftrightunsigned("row", BITS)).sortWithinPartitions("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(columns: list[np.ndarray]) -> pa.RecordBatch:
            out = work(columns[0].view(np.uint64), *columns[1:]).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(c.copy()) for c in out.T], names)

        held, enough = [np.empty(0, np.int64)] * (1 + len(more)), CHUNK
        for batch in batches:
            held = [np.concatenate([h, c.to_numpy(zero_copy_only=False)])
                    for h, c in zip(held, batch.columns, strict=True)]
            rows = held[0].view(np.uint64)
            if len(rows) >= enough:
                last = rows[-1] >> np.uint64(BITS) << np.uint64(BITS)  # this bucket may go on
                whole = int(np.searchsorted(rows, last))
                if whole:
                    yield found([h[:whole] for h in held])
                held = [h[whole:] for h in held]
                enough = max(CHUNK, 2 * len(held[0]))
        if len(held[0]):
            yield found(held)

    return sent.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def neighbours(prints: DataFrame) -> DataFrame:
    """All pairs (ga, gb) of distinct fingerprints (column ``grp``) of one number that differ in at
    most ``RADIUS`` bits. Of a column ``label``, pairs that share a label other than 0 are left out:
    a large class would have them by the square of its size. Of columns ``low`` and ``most``, so are
    pairs whose sizes do not admit each other, and of a column ``met`` all that are not marked."""
    if "met" in prints.columns:
        prints = prints.where("met")
    given = {"label": 0, "low": 0, "most": np.iinfo(np.int64).max}
    full = prints.select("grp", *[F.col(c) if c in prints.columns else F.lit(int(v)).cast("long").alias(c)
                                  for c, v in given.items()])
    return _in_buckets(full, [*given], meet, ["ga", "gb"]).distinct()


def crowds(prints: DataFrame) -> DataFrame:
    """grp, times (meetings with others, at least one for each) of the fingerprints that have
    neighbours of another label or of none; no pair is formed."""
    return _in_buckets(prints.select("grp", "label"), ["label"], crowd, ["grp", "times"]).groupBy("grp").agg(
        F.sum("times").alias("times"))


def _sided(df: DataFrame, side: str) -> DataFrame:
    return df.select(*[F.col(c).alias(side if c == "node" else f"{side}_{c}") for c in df.columns])


def _apart() -> Column:
    """Number of differing bits of the sketches of a and b."""
    return sum((F.bit_count(F.col(f"a_{s}").bitwiseXOR(F.col(f"b_{s}"))) for s in _SKETCH), F.lit(0))


def _first_meeting(number: Column) -> Column:
    """Whether no fingerprint of a and b before that of this number is within the radius."""
    def apart(k: int) -> Column:
        changed = F.col(f"a_{_SKETCH[k // 2]}").bitwiseXOR(F.col(f"b_{_SKETCH[k // 2]}"))
        return F.bit_count(F.shiftrightunsigned(changed, BITS * (k % 2)).bitwiseAND(F.lit((1 << BITS) - 1)))

    out = F.lit(True)
    for k in range(PRINTS):
        out = out & ((number <= k) | (apart(k) > RADIUS))
    return out


def _fits(known: DataFrame) -> Column:
    """Whether a and b may have the wanted similarity by all bits and, where known, by their sizes."""
    near = _apart() <= MOST_APART
    return near & F.expr("a_n <= b_most AND b_n <= a_most") if "most" in known.columns else near


def _close(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes that may have the wanted similarity by what is known of them."""
    return (pairs.join(_sided(known, "a"), "a").join(_sided(known, "b"), "b")
            .where(_fits(known)).select("a", "b"))


def _similar(close: DataFrame, sets_of) -> DataFrame:
    """The pairs (a, b) of nodes whose shingle sets have the wanted similarity."""
    sets = cut(sets_of(close.select(F.explode(F.array("a", "b")).alias("node")).distinct()))
    common = F.size(F.array_intersect("a_shingles", "b_shingles"))
    total = F.size("a_shingles") + F.size("b_shingles") - common
    return (close.join(_sided(sets, "a"), "a").join(_sided(sets, "b"), "b")
            .where(common >= F.lit(SIMILARITY) * total).select("a", "b"))


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()


def _labelled(members: DataFrame, roots: DataFrame) -> DataFrame:
    """``members`` (grp, node), label (the class that the node is known to belong to), linked (with another)."""
    return members.join(roots, "node", "left").select(
        *members.columns, F.coalesce("root", "node").alias("label"), F.col("root").isNotNull().alias("linked"))


def _joined(roots: DataFrame, found: DataFrame) -> DataFrame:
    """Classes known so far (node, root) after the links ``found`` (a, b)."""
    return cut(components(found.unionByName(roots.select(F.col("node").alias("a"),
                                                         F.col("root").alias("b")))))


def classes(sketches: DataFrame, sets_of) -> DataFrame:
    """node, root of all nodes that links connect with another.

    ``sketches`` has one row per node. First every fingerprint names one of its nodes, with which
    its others are compared. Large groups of near copies fall into few classes so, and only
    fingerprints of different classes are then met with their neighbours: the pairs of a large class
    are never formed. While the pairs of nodes that lie in different classes are many and a round
    halves them, more nodes are named, by a hash that changes with the round, and the named ones
    of neighbouring fingerprints are compared too. Before that, nodes whose own shingles alone keep
    them from the wanted similarity with all that they meet are set aside (``_able``). Then all pairs
    left are compared: no pair that meets and can be similar is left out. ``sets_of(nodes)`` gives
    their shingle sets.
    """
    prints = sketches.where("node <> 0").select("node", F.explode(print_columns()).alias("grp"))
    tested = cut(_ordered(_inside(prints, 0)))
    roots = sketches.sparkSession.createDataFrame([], "node long, root long")
    found = cut(_similar(cut(_close(tested, sketches)), sets_of))
    if not found.isEmpty():
        roots = _joined(roots, found)
    labelled = cut(_labelled(prints, roots))
    held = cut(_held(labelled))
    # pairs within a fingerprint count as meetings too
    met = cut(crowds(held).join(held.select("grp", "n", (F.col("lo") != F.col("hi")).alias("open")), "grp", "right")
              .where("open OR times > 0")
              .select("grp", "n", (F.coalesce("times", F.lit(0)) + F.when(F.col("open"), F.col("n") - 1)
                                   .otherwise(0)).alias("times")))
    labelled = cut(labelled.join(met, "grp", "left_semi"))
    size, meetings = met.agg(F.coalesce(F.sum("n"), F.lit(0)),
                             F.coalesce(F.sum(F.col("n") * F.col("times")), F.lit(0))).first()
    known = sketches
    if FEW * COUNTED * size < meetings:
        sizes = cut(_sizes(sets_of(labelled.select("node").distinct())))
        labelled = cut(labelled.join(sizes, "node"))
        known = cut(sketches.join(sizes, "node"))
    apart = cut(_held(labelled).withColumn("met", F.lit(True)))
    # within a fingerprint, as between two, the least size has to be admitted
    pairs = cut(neighbours(held.select("grp").join(apart, "grp", "left")).unionByName(
        apart.where("lo <> hi").select(F.col("grp").alias("ga"), F.col("grp").alias("gb"))))
    labelled = cut(_able(labelled, pairs))
    size = labelled.count()
    round_, before = 1, float("inf")
    while size:
        pairs = cut(_open(pairs, labelled, round_))
        left = pairs.agg(F.coalesce(F.sum("left"), F.lit(0))).first()[0]
        if not FEW * size < left <= before / 2:
            break
        across = pairs.where("ga < gb AND la <> lb").select("a", "b")
        now = cut(_ordered(_inside(labelled, round_).unionByName(across)).join(
            tested, ["a", "b"], "left_anti"))
        found = cut(_similar(cut(_close(now, known)), sets_of))
        tested = cut(tested.unionByName(now))
        if found.isEmpty():
            break
        roots = _joined(roots, found)
        labelled = cut(_labelled(labelled.drop("label", "linked"), roots))
        round_, before = round_ + 1, left
    if size:
        parts = labelled.select("grp", "label").distinct()
        open_ = (pairs.select("ga", "gb").join(_side(parts, "a"), "ga").join(_side(parts, "b"), "gb")
                 .where("la <> lb AND (ga < gb OR la < lb)"))
        held = cut(labelled.select("grp", "label", "node").join(known, "node"))

        def side(x: str) -> DataFrame:
            return _sided(held, x).withColumnsRenamed({f"{x}_grp": f"g{x}", f"{x}_label": f"l{x}"})

        rest = (open_.join(side("a"), ["ga", "la"]).join(side("b"), ["gb", "lb"])
                .where(_fits(known) & _first_meeting(F.shiftright("ga", BITS)))
                .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                .join(tested, ["a", "b"], "left_anti"))
        found = cut(_similar(cut(rest), sets_of))
        if not found.isEmpty():
            roots = _joined(roots, found)
    return roots


def _sizes(sets: DataFrame) -> DataFrame:
    """node, n (its shingles), most (the largest size of a set that can be similar to it), for the
    given sets alone.

    Two sets share at most what of either one is not its own, that is, occurs in another of the
    sets. Of sizes n and m they need SIMILARITY / (1 + SIMILARITY) of n + m in common, which bounds m.
    """
    each = sets.select("node", F.explode("shingles").alias("shingle"))
    alone = (each.groupBy("shingle").agg(F.count(F.lit(1)).alias("times"), F.min("node").alias("node"))
              .where("times = 1").groupBy("node").agg(F.count(F.lit(1)).alias("own")))
    common = F.col("n") - F.coalesce("own", F.lit(0))
    most = F.floor(common * F.lit((1 + SIMILARITY) / SIMILARITY) - F.col("n") + F.lit(1e-6))
    return (sets.select("node", F.size("shingles").cast("long").alias("n")).join(alone, "node", "left")
            .select("node", "n", most.alias("most")))


def _held(labelled: DataFrame) -> DataFrame:
    """One row per fingerprint: its least and greatest label, number of nodes, the label that all
    its nodes share (0: none) and, where sizes are known, the least and the most they admit."""
    sizes = [F.min("n").alias("low"), F.max("most").alias("most")] if "most" in labelled.columns else []
    # a node that nothing is linked with has a label of its own, which 0 stands for
    return (labelled.groupBy("grp").agg(
        F.min("label").alias("lo"), F.max("label").alias("hi"), F.max("linked").alias("linked"),
        F.count(F.lit(1)).alias("n"), *sizes)
        .withColumn("label", F.when(F.expr("linked AND lo = hi"), F.col("lo")).otherwise(F.lit(0))))


def _able(labelled: DataFrame, pairs: DataFrame) -> DataFrame:
    """The rows of ``labelled`` whose node can be similar to one that it meets there.

    Of two similar sets, the smaller one admits a set of its own size (n <= most). Others can only
    be similar to such ones, and stay where one of a size that they admit is met. So those with
    more than a ninth of shingles of their own (at similarity 0.8) form no pairs with each other.
    """
    both = pairs.toDF("grp", "near").unionByName(pairs.toDF("near", "grp"))
    if "most" not in labelled.columns:
        return labelled.join(both.select("grp").distinct(), "grp", "left_semi")
    least = labelled.groupBy(F.col("grp").alias("near")).agg(
        F.min(F.when(F.expr("n <= most"), F.col("n"))).alias("least"))
    around = both.join(least, "near").groupBy("grp").agg(F.min("least").alias("least"))
    return labelled.join(around, "grp").where("n <= most OR least <= most").drop("least")


def _open(pairs: DataFrame, labelled: DataFrame, round_: int) -> DataFrame:
    """The pairs of fingerprints whose nodes may lie in different classes, with a named node of each
    (a, b), its class (la, lb) and ``left``: at most so many pairs of nodes in different classes, all pairs less those
    of the class that has most nodes in both. No pair of nodes is formed."""
    sizes = [F.min("n").alias("low"), F.max("most").alias("most")] if "most" in labelled.columns else []
    parts = labelled.groupBy("grp", "label").agg(
        F.count(F.lit(1)).cast("double").alias("c"),
        F.min(F.struct(F.xxhash64(F.lit(round_), "node").alias("h"), "node")).alias("named"), *sizes)
    whole = cut(parts.groupBy("grp").agg(
        F.sum("c").alias("all"), F.max(F.struct("c", "label")).alias("top"),
        F.min(F.struct("named", "label")).alias("named"),
        *[f(F.col(c)).alias(c) for f, c in ((F.min, "low"), (F.max, "most")) if sizes]))

    def side(x: str) -> DataFrame:
        more = [F.col(c).alias(f"{x}_{c}") for c in ("low", "most") if sizes]
        return whole.select(F.col("grp").alias(f"g{x}"), F.col("all").alias(f"{x}_all"),
                            F.col("top.c").alias(f"{x}_c"), F.col("top.label").alias(f"{x}_label"),
                            F.col("named.named.node").alias(x), F.col("named.label").alias(f"l{x}"), *more)

    every, alike = F.col("a_all") * F.col("b_all"), F.col("a_c") * F.col("b_c")
    left = F.when(F.col("a_label") == F.col("b_label"), every - alike).otherwise(every)
    admitted = F.expr("a_low <= b_most AND b_low <= a_most") if sizes else F.lit(True)
    return (pairs.select("ga", "gb").join(side("a"), "ga").join(side("b"), "gb")
            .select("ga", "gb", "a", "b", "la", "lb", left.alias("left"), admitted.alias("admitted"))
            .where("left > 0 AND admitted").drop("admitted"))


def _inside(members: DataFrame, round_: int) -> DataFrame:
    """The nodes (a) of each fingerprint with a named one of its nodes (b), taken by a hash of the
    round, but for those of the named one's class (column ``label``, if there is one)."""
    has = [c for c in members.columns if c == "label"]
    named = members.groupBy("grp").agg(
        F.min(F.struct(F.xxhash64(F.lit(round_), "node").alias("h"), "node", *has)).alias("m"),
        F.count(F.lit(1)).alias("n")).where("n > 1").select("grp", "m")
    other = F.col("label") != F.col("m.label") if has else F.lit(True)
    return members.select("grp", "node", *has).join(named, "grp").where(other).select(
        F.col("node").alias("a"), F.col("m.node").alias("b"))


def _side(df: DataFrame, side: str) -> DataFrame:
    names = {"grp": f"g{side}", "label": f"l{side}", "node": side}
    return df.select(*[F.col(c).alias(names.get(c, f"{c}{side}")) for c in df.columns])


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, without all but one document of each class of near
    copies: the one of the smallest doc_id (nulls last), then of the smallest hash of the row.

    Documents are near copies if the sets of their five-word shingles (A-Z lower-cased; fewer
    words: the whole sequence) have Jaccard similarity 0.8 or more; classes are what such links
    connect. Documents of the same words are one node, so a group of copies costs one node; texts
    that are null, empty or without words are copies of each other. Repeated rows are copies. Words,
    shingles and texts are told apart by 64-bit hashes.
    """
    hashed = docs.select(*row_hashes(docs), *[F.col(f"`{c}`").alias(f"k_{c}") for c in docs.columns])
    slim = cut(_sketched(hashed, f"k_{text}", [f"k_{doc_id}", "_row1", "_row2"]).withColumnRenamed(
        f"k_{doc_id}", "_id"))
    first = F.min(F.struct(F.col("_id").isNull().alias("n"), "_id", "_row1", "_row2"))
    nodes = cut(slim.groupBy("node").agg(first.alias("_first"), *[F.first(s).alias(s) for s in _SKETCH]))

    def sets_of(wanted: DataFrame) -> DataFrame:
        rows = nodes.join(wanted, "node", "left_semi").select("node", "_first._row1", "_first._row2")
        texts = hashed.select("_row1", "_row2", f"k_{text}").join(rows, ["_row1", "_row2"])
        return _shingle_sets(texts.dropDuplicates(["node"]), f"k_{text}")

    roots = classes(nodes.select("node", *_SKETCH), sets_of)
    kept = (nodes.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root"))
            .agg(F.min("_first").alias("_first")).select("_first._row1", "_first._row2"))
    return (hashed.dropDuplicates(["_row1", "_row2"]).join(kept, ["_row1", "_row2"], "left_semi")
            .select(*[F.col(f"`k_{c}`").alias(c) for c in docs.columns]))
