"""Bytes in long repeated passages, marked by run-length compressed indexes over buckets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vouch.llm.common import read, text_bytes, text_slices
from vouch.operators.lineage import cut

#: Length of a match, and of the strings whose smallest hash brings equal windows together.
LENGTH, GRAM = 400, 128
#: Different segments under one key up to which they share an index; larger keys are split.
KEY_SEGMENTS = 1024
#: Text of an index, on average: one bucket of keys.
INDEX_BYTES = 1 << 18
#: Buckets that the windows of keys too large even after the split are dealt to.
WINDOW_BUCKETS = 256
SLICE = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_ONE = np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(30))


#: A random number for each byte value.
BYTES = _mixed((np.arange(256, dtype=np.uint64) + _ONE) * np.uint64(_BASE))


@lru_cache(maxsize=2)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    n = 1 << bits
    inverse = pow(_BASE, -1, 1 << 64)
    return tuple(np.concatenate([[_ONE], np.cumprod(np.full(n - 1, b, np.uint64))])
                 for b in (_BASE, inverse))


class Hashes:
    """Hashes of any substring of some bytes, from prefix sums."""

    def __init__(self, data: np.ndarray):
        up, self.down = _powers(max(int(len(data)).bit_length(), 8))
        self.sums = np.concatenate([np.zeros(1, np.uint64),
                                    np.cumsum(BYTES[data] * up[:len(data)])])

    def all(self, length: int) -> np.ndarray:
        """Of every substring of one length."""
        n = max(len(self.sums) - length, 0)
        return _mixed((self.sums[length:] - self.sums[:n]) * self.down[:n])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        raw = (self.sums[ends] - self.sums[starts]) * self.down[starts]
        return _mixed(raw + (ends - starts).astype(np.uint64) * BYTES[7])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Smallest of every ``width`` neighbours, by doubling."""
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[:len(x) - (width - have)], x[width - have:]) if have < width else x


def segments(data: np.ndarray, starts: np.ndarray, length: int, gram: int,
             ) -> tuple[np.ndarray, ...]:
    """Cut the windows of all texts into runs that share their smallest gram hash.

    Equal windows have equal grams, so they fall under equal keys. Returns for each run the number
    of its text, first byte, byte after (of the last window), key, hash of the bytes, and whether
    the smallest gram stands in it twice (only then can a window repeat inside the run).
    """
    none = np.empty(0, np.int64)
    sizes = np.diff(starts)
    windows = np.maximum(sizes - length + 1, 0)
    if not windows.sum():
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64), none.astype(bool)
    hashes = Hashes(data)
    grams = hashes.all(gram)
    width = length - gram + 1
    least = sliding_min(grams, width)
    text = np.repeat(np.arange(len(sizes)), windows)
    at = np.arange(len(text)) + (starts[:-1] - (np.cumsum(windows) - windows))[text]
    least = least[at]
    new = np.concatenate([[True], (least[1:] != least[:-1]) | (text[1:] != text[:-1])])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(at)]]) - 1
    begin, end, key = at[first], at[last] + length, least[first]
    # where the smallest grams stand: a small table of hashes leaves few to look up
    values = np.unique(key)
    table = np.zeros(1 << 20, bool)
    table[values >> np.uint64(44)] = True
    near = np.flatnonzero(table[grams >> np.uint64(44)])
    place = np.minimum(np.searchsorted(values, grams[near]), len(values) - 1)
    hit = values[place] == grams[near]
    stands = np.sort(place[hit] * (len(data) + 1) + near[hit])
    of_key = np.searchsorted(values, key) * (len(data) + 1)
    times = np.searchsorted(stands, of_key + end - gram, "right") \
        - np.searchsorted(stands, of_key + begin)
    return text[first], begin, end, key, hashes.of(begin, end), times > 1


class RunIndex:
    """Run-length compressed Burrows-Wheeler transform of several strings, with the text places of
    each run's start (sampled run ends).

    Suffixes are sorted by doubling; every string ends in a sign of its own. ``heads`` are the rows
    where a run of equal transform characters starts, ``here`` and ``above`` the text places of
    that row and the one before: the last of the run above.
    """

    def __init__(self, strings: list[bytes]):
        m = len(strings)
        self.starts = np.concatenate([[0], np.cumsum([len(s) + 1 for s in strings])])
        self.symbols = np.empty(self.starts[-1], np.int64)
        for k, s in enumerate(strings):
            a = self.starts[k]
            self.symbols[a:a + len(s)] = np.frombuffer(s, np.uint8).astype(np.int64) + m
            self.symbols[a + len(s)] = k
        order = self._sorted(m + 256)
        before = self.symbols[order - 1]  # the character before the first is the last sign
        self.heads = np.flatnonzero(np.concatenate([[True], before[1:] != before[:-1]]))
        self.runs = before[self.heads]
        self.here = order[self.heads]
        self.above = np.where(self.heads > 0, order[np.maximum(self.heads - 1, 0)], -1)

    def _sorted(self, alphabet: int) -> np.ndarray:
        """The suffix array; ``self.ranks`` keeps the ranks by the first 1, 2, 4, ... signs."""
        n = len(self.symbols)
        rank, step, self.ranks = self.symbols, 1, []
        bits = max(int(max(n, alphabet)).bit_length(), 1)
        self.ranks.append(rank.astype(np.int32))
        while True:
            second = np.zeros(n, np.int64)
            second[:max(n - step, 0)] = rank[step:] + 1
            if 3 * bits + 1 <= 64:  # both ranks and the place fit one number
                packed = np.sort((rank.astype(np.uint64) << np.uint64(2 * bits + 1))
                                 | (second.astype(np.uint64) << np.uint64(bits))
                                 | np.arange(n, dtype=np.uint64))
                order = (packed & np.uint64((1 << bits) - 1)).astype(np.int64)
                packed >>= np.uint64(bits)
                new = packed[1:] != packed[:-1]
            else:
                order = np.lexsort((second, rank))
                new = (rank[order[1:]] != rank[order[:-1]]) | (
                    second[order[1:]] != second[order[:-1]])
            rank = np.empty(n, np.int64)
            rank[order] = np.concatenate([[0], np.cumsum(new)])
            if n == 0 or rank[order[-1]] == n - 1:
                return order
            step *= 2
            self.ranks.append(rank.astype(np.int32))

    def common(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Length of the common front of the suffixes at p and q, by the kept ranks."""
        p, q = p.copy(), q.copy()
        out = np.zeros(len(p), np.int64)
        n = len(self.symbols)
        for k in range(len(self.ranks) - 1, -1, -1):
            rank, step = self.ranks[k], 1 << k
            while True:
                inside = (p < n) & (q < n)
                same = inside & (rank[np.minimum(p, n - 1)] == rank[np.minimum(q, n - 1)])
                if not same.any():
                    break
                p[same] += step
                q[same] += step
                out[same] += step
        return out

    def statistics(self, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matches (place, place, length) at the starts of runs, those of at least ``least``.

        Read along the text, the longest match of the suffix at a place is one shorter than at the
        place before unless a run starts there; so the matches at run starts stand for those of all
        places: a match there covers all places up to its end.
        """
        at = np.flatnonzero(self.above >= 0)
        p, q = self.here[at], self.above[at]
        # two looks at ranks of half the length tell which reach it
        k = min(max(least.bit_length() - 1, 0), len(self.ranks) - 1)
        half, n = 1 << k, len(self.symbols)
        if half <= least:
            for shift in (0, least - half):
                ok = (p + shift < n) & (q + shift < n)
                p, q = p[ok], q[ok]
                same = self.ranks[k][p + shift] == self.ranks[k][q + shift]
                p, q = p[same], q[same]
        size = self.common(p, q)
        long = size >= least
        return p[long], q[long], size[long]

    def marks(self, least: int) -> list[list[tuple[int, int]]]:
        """For each string the ranges of bytes that lie in a match of at least ``least`` bytes with
        another place."""
        p, q, size = self.statistics(least)
        change = np.zeros(len(self.symbols) + 1, np.int64)
        for x in (p, q):
            np.add.at(change, x, 1)
            np.add.at(change, x + size, -1)
        covered = np.cumsum(change)[:-1] > 0
        edges = np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]]).astype(np.int8)))
        out: list[list[tuple[int, int]]] = [[] for _ in self.starts[1:]]
        # a match never covers a string's end sign, so a range lies in one string
        for a, b in edges.reshape(-1, 2).tolist():
            k = int(np.searchsorted(self.starts, a, "right")) - 1
            s = int(self.starts[k])
            out[k].append((a - s, b - s))
        return out


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


RANGES = "array<struct<a: int, b: int>>"


def repeated_ranges(docs: DataFrame, length: int = LENGTH, gram: int = GRAM,
                    key_segments: int = KEY_SEGMENTS) -> DataFrame:
    """Byte ranges (d1, d2, a, b) of the documents that lie in a repeated string of ``length``
    bytes; overlapping ranges are not merged. ``docs`` has d1, d2 (a hash of the row) and text.

    1. Each text is cut into runs of windows with the same smallest gram (about ``length`` - gram
       / 2 windows each). Only key, content hash and place of a run are shuffled.
    2. Runs of equal content are folded: two of them repeat all their windows. A run alone under
       its key, without its gram twice, repeats none. What is left are keys with several contents.
    3. The text of one run of each content goes to a bucket of keys, where a run-length index of
       all contents marks the matches between and within them.
    4. Keys with more than ``key_segments`` contents (large groups of near copies, the edges of a
       passage that a large part of the documents share) would make an index of unbounded size.
       Their runs are cut again with a gram almost as long as a window: what differs inside it
       falls under other keys. Then 2 and 3 apply once more.
    5. Where even such a key has too many contents, its windows are dealt by their own hash and
       counted, which splits the key over all tasks.
    """
    core = length - max((length - gram) // 4, 1)
    runs = cut(_runs(docs, length, gram))
    folded = runs.groupBy("key", "content").agg(
        F.count(F.lit(1)).alias("times"), F.max("twice").alias("twice"),
        F.min(F.struct("d1", "d2", "a", "b")).alias("at"))
    folded = cut(folded)
    keys = folded.groupBy("key").agg(F.count(F.lit(1)).alias("contents"), F.max("twice").alias("any"))
    open_ = keys.where("contents > 1 OR any").select("key", (F.col("contents") > key_segments)
                                                     .alias("hot"))
    wanted = folded.join(open_, "key").select("at.*", "key", "hot")
    bytes_ = wanted.where("NOT hot").agg(F.sum(F.col("b") - F.col("a"))).first()[0] or 0
    buckets = max(64, -(-bytes_ // INDEX_BYTES))
    lists = wanted.groupBy("d1", "d2").agg(
        F.collect_list(F.struct("a", "b", "key", "hot")).alias("parts"))
    found = docs.join(lists, ["d1", "d2"]).select("d1", "d2", "parts", "text")
    taken = cut(found.mapInArrow(_taker, "d1 long, d2 long, a int, key long, hot boolean, piece binary"))
    large = taken.where("hot").select("d1", "d2", "a", "piece")
    finer = cut(large.mapInArrow(_finer(length, core), "d1 long, d2 long, o int, a int, b int, "
                                                       "key long, content long, twice boolean"))
    again = cut(finer.groupBy("key", "content").agg(
        F.count(F.lit(1)).alias("times"), F.max("twice").alias("twice"),
        F.min(F.struct("d1", "d2", "o", "a", "b")).alias("at")))
    crowded = again.groupBy("key").agg(F.count(F.lit(1)).alias("contents"),
                                       F.max("twice").alias("any"))
    crowded = crowded.where("contents > 1 OR any").select(
        "key", (F.col("contents") > key_segments).alias("hot"))
    lists = again.join(crowded, "key").groupBy("at.d1", "at.d2", F.col("at.o").alias("a")).agg(
        F.collect_list(F.struct("at.a", "at.b", "key", "hot")).alias("parts"))
    split = cut(large.join(lists, ["d1", "d2", "a"]).select(
        "d1", "d2", F.explode("parts").alias("p"), (F.col("p.a") - F.col("a")).alias("from"), "piece")
        .select("d1", "d2", F.col("p.a").alias("a"), "p.key", "p.hot", F.substring(
            F.col("piece"), F.col("from") + 1, F.col("p.b") - F.col("p.a")).alias("piece")))

    def index(table: pa.Table) -> pa.Table:
        strings = table.column("piece").to_pylist()
        marks = RunIndex(strings).marks(length)
        of = np.repeat(np.arange(len(marks)), [len(m) for m in marks])
        flat = np.array([r for m in marks for r in m], np.int64).reshape(-1, 2)
        a = table.column("a").to_numpy()[of]
        return pa.table([table.column("d1").to_numpy()[of], table.column("d2").to_numpy()[of],
                         (flat[:, 0] + a).astype(np.int32), (flat[:, 1] + a).astype(np.int32)],
                        names=["d1", "d2", "a", "b"])

    def counted(table: pa.Table) -> pa.Table:
        hashes, places = (np.concatenate([np.frombuffer(b, kind) for b in table.column(c).to_pylist()])
                          for c, kind in (("hashes", np.uint64), ("places", PLACE)))
        order = np.argsort(hashes, kind="stable")
        same = hashes[order][1:] == hashes[order][:-1]
        rows = places[order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]]
        # windows of a text that overlap are one range
        rows = np.sort(rows, order=("d1", "d2", "a"))
        near = (rows["d1"][1:] == rows["d1"][:-1]) & (rows["d2"][1:] == rows["d2"][:-1]) \
            & (rows["a"][1:] - rows["a"][:-1] <= length)
        first = np.flatnonzero(np.concatenate([[len(rows) > 0], ~near])[:len(rows)])
        last = np.append(first[1:], len(rows))[:len(first)] - 1
        return pa.table([rows["d1"][first].copy(), rows["d2"][first].copy(), rows["a"][first].copy(),
                         rows["a"][last] + np.int32(length)], names=["d1", "d2", "a", "b"])

    schema = "d1 long, d2 long, a int, b int"
    bucket = F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket")
    strings = ["d1", "d2", "a", "piece"]
    indexed = taken.where("NOT hot").select(bucket, *strings).unionByName(
        split.where("NOT hot").select(bucket, *strings)).groupBy("bucket").applyInArrow(index, schema)
    windows = split.where("hot").select(*strings).mapInArrow(
        _packer(length), "bucket int, hashes binary, places binary").groupBy("bucket").applyInArrow(counted, schema)
    copied = folded.where("times > 1").select("key", "content")
    whole = runs.join(copied, ["key", "content"]).select("d1", "d2", "a", "b")
    copied = again.where("times > 1").select("key", "content")
    inner = finer.join(copied, ["key", "content"]).select("d1", "d2", "a", "b")
    return whole.unionByName(inner).unionByName(indexed).unionByName(windows)


def _runs(docs: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch, "text", SLICE):
                data, starts = text_bytes(texts)
                text, a, b, key, content, twice = segments(data, starts, length, gram)
                d1, d2 = (part.column(c).to_numpy()[text] for c in (0, 1))
                base = starts[text]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(d1), pa.array(d2), pa.array((a - base).astype(np.int32)),
                     pa.array((b - base).astype(np.int32)), pa.array(key.view(np.int64)),
                     pa.array(content.view(np.int64)), pa.array(twice)],
                    ["d1", "d2", "a", "b", "key", "content", "twice"])

    return docs.select("d1", "d2", "text").mapInArrow(
        run, "d1 long, d2 long, a int, b int, key long, content long, twice boolean")


def _taker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Gives the bytes of the wanted parts of each text."""
    for batch in batches:
        for part, texts in text_slices(batch, "text", SLICE):
            rows: list[tuple] = []
            for d1, d2, parts, text in zip(*(part.column(k).to_pylist() for k in range(3)),
                                           texts.to_pylist(), strict=True):
                raw = text.encode()
                rows += [(d1, d2, p["a"], p["key"], p["hot"], raw[p["a"]:p["b"]]) for p in parts]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), (
                    pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.binary()),
                    strict=True)], ["d1", "d2", "a", "key", "hot", "piece"])


def _finer(length: int, core: int):
    """Cuts pieces into runs of windows again, by their smallest gram of length ``core``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts = text_bytes(batch.column(3))
            of, a, b, key, content, twice = segments(data, starts, length, core)
            d1, d2, o = (batch.column(k).to_numpy()[of] for k in range(3))
            shift = o - starts[of]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (d1, d2, o, (a + shift).astype(np.int32),
                                       (b + shift).astype(np.int32), key.view(np.int64),
                                       content.view(np.int64), twice)],
                ["d1", "d2", "o", "a", "b", "key", "content", "twice"])

    return run


#: Where a window on its way to be counted comes from.
PLACE = np.dtype([("d1", "<i8"), ("d2", "<i8"), ("a", "<i4")])


def _packer(length: int):
    """All windows of the pieces by hash, packed: one row for each bucket and batch. Windows of
    one piece follow each other in a bucket, so that their places compress."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts = text_bytes(batch.column(3))
            n = np.diff(starts) - length + 1
            of = np.repeat(np.arange(len(n)), n)
            inside = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            at = starts[of] + inside
            hashes = Hashes(data).of(at, at + length)
            order = np.argsort(hashes >> np.uint64(56), kind="stable")
            hashes, of, inside = hashes[order], of[order], inside[order]
            places = np.empty(len(of), PLACE)
            for c in ("d1", "d2"):
                places[c] = batch.column(c).to_numpy()[of]
            places["a"] = batch.column("a").to_numpy()[of] + inside
            cuts = np.searchsorted(hashes >> np.uint64(56),
                                   np.arange(WINDOW_BUCKETS + 1, dtype=np.uint64))
            full = np.flatnonzero(np.diff(cuts))
            yield pa.RecordBatch.from_arrays(
                [pa.array(full.astype(np.int32)), *(pa.array(
                    [x[cuts[k]:cuts[k + 1]].tobytes() for k in full], pa.binary())
                    for x in (hashes, places))], ["bucket", "hashes", "places"])

    return run


OUT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def without_repeats(docs: DataFrame, text: str = "text", keep: list[str] | None = None,
                    length: int = LENGTH, gram: int = GRAM, key_segments: int = KEY_SEGMENTS,
                    with_text: bool = True) -> DataFrame:
    """Columns ``keep`` (default: all but the text), then n_bytes, n_removed, n_spans (maximal
    removed runs), kept_sha256, and with ``with_text`` the kept bytes and the removed spans.

    A byte goes if some ``length`` bytes around it also start anywhere else, in any row of
    ``docs``. Null texts count as empty; texts shorter than ``length`` stay whole; of repeated
    rows both go. Removal is by byte, so a kept text may begin inside a character.
    """
    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"][:4 + 2 * with_text]
    keep = [c for c in docs.columns if c != text and c not in names] if keep is None else keep
    held = docs.select(*[docs[c].alias(f"k_{c}") for c in keep],
                       F.coalesce(docs[text], F.lit("")).alias("text"))
    whole = [F.col(f"`k_{c}`") for c in keep] + [F.col("text")]
    rows = held.withColumns({"d1": F.xxhash64(*whole), "d2": F.xxhash64(F.lit("second"), *whole)})
    ranges = repeated_ranges(rows.select("d1", "d2", "text"), length, gram, key_segments)
    lists = ranges.groupBy("d1", "d2").agg(F.collect_set(F.struct("a", "b")).alias("ranges"))
    joined = rows.join(lists, ["d1", "d2"], "left").select(
        *[f"k_{c}" for c in keep], "ranges", "text")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema[:-2]]
    kinds = [pa.int64()] * 3 + [pa.string(), pa.binary(), pa.list_(pa.struct(
        [("a", pa.int32()), ("b", pa.int32())]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch, "text"):
                out = []
                for t, found in zip(texts.to_pylist(), part.column(part.num_columns - 2).to_pylist(),
                                    strict=True):
                    raw = t.encode()
                    spans = merged([(r["a"], r["b"]) for r in found or ()])
                    cuts = [0, *(x for s in spans for x in s), len(raw)]
                    left = b"".join(raw[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True))
                    out.append((len(raw), len(raw) - len(left), len(spans),
                                hashlib.sha256(left).hexdigest(), left,
                                [{"a": a, "b": b} for a, b in spans]))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-2], *(pa.array([o[k] for o in out], kinds[k])
                                           for k in range(len(names)))],
                    [*part.schema.names[:-2], *names])

    schema = ", ".join([*fields, OUT]) + f", kept binary, spans {RANGES}" * with_text
    return joined.mapInArrow(run, schema).select(
        *[F.col(f"`k_{c}`").alias(c) for c in keep], *names)


def op4_run_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of operator 4 for every document."""
    return without_repeats(read(spark, sf_dir, "documents"), keep=["doc_id"], with_text=False)
