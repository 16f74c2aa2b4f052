"""Passages of test sets in documents: Wu-Manber search for many word windows at once."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vouch.llm.common import digest, read, running_sum, text_bytes, text_slices
from vouch.operators.lineage import cut

#: Words of a window; an item of fewer words is one window.
WINDOW = 10
#: Test text (words and one space each) that one broadcast table may hold.
BLOCK_BYTES = 4 << 20
#: Words of a piece; a longer item is cut into pieces that share ``WINDOW - 1`` words.
PIECE_WORDS = 20_000
#: Window ends that one pointer of the search looks after.
STRETCH = 128
#: Windows of buckets that are compared in one step.
COMPARED = 1 << 20
#: Copies of the found rows that copies of one text are dealt over, where there are several tables.
SALTS = 16

#: Each byte as a word has it, lower-cased; 0 for bytes between words.
_BYTES = np.zeros(256, np.uint8)
for _b in (*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)):
    _BYTES[_b] = _b
_BYTES[0x41:0x5B] = np.arange(0x61, 0x7B)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
    x = (x ^ (x >> np.uint64(28))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Words:
    """The words of many texts: one after the other in ``data``, each followed by a space."""

    def __init__(self, texts: pa.Array):
        raw, bounds = text_bytes(texts)
        raw = _BYTES[raw]
        inside = raw != 0
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        edges = bounds[1:-1]
        edges = edges[(edges > 0) & (edges < len(raw))]
        first[edges] = inside[edges]
        last[edges - 1] = inside[edges - 1]
        start = np.flatnonzero(first)
        size = np.flatnonzero(last) + 1 - start
        doc = np.searchsorted(bounds, start, "right") - 1
        #: words of each text, and where its first one is
        self.counts = np.bincount(doc, minlength=len(texts))[:len(texts)]
        self.starts = np.cumsum(self.counts) - self.counts
        self.end = np.cumsum(size + 1) - 1
        self.begin, self.size = self.end - size, size
        # eight bytes in front, so that every word has eight bytes before its end
        data = np.full(8 + int(size.sum()) + len(size), 0x20, np.uint8)
        data[np.arange(8, 8 + int(size.sum())) + np.repeat(np.arange(len(size)), size)] = raw[inside]
        self._eights = np.ndarray(len(data) - 7, np.uint64, data, strides=(1,))
        self.data = memoryview(data)[8:]

    def sign(self, at: np.ndarray) -> np.ndarray:
        """A number for each of the given words, from its length and last eight bytes."""
        size = np.minimum(self.size[at], 8).astype(np.uint64)
        tail = self._eights[self.end[at]] >> (np.uint64(8) * (np.uint64(8) - size))
        return _mixed(tail + self.size[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def block(self, at: np.ndarray, width: int) -> np.ndarray:
        """A number for the ``width`` (1 or 2) words that end with each of the given ones."""
        sign = self.sign(at)
        return sign if width == 1 else _mixed(self.sign(at - 1) * np.uint64(3) + sign)

    def key(self, end: np.ndarray, length: int, width: int) -> np.ndarray:
        """The bucket of a window: its last and first block."""
        return _mixed(self.block(end, width) * np.uint64(5)
                      + self.block(end - length + width, width))


@dataclass
class Machine:
    """Shift table and buckets for windows of one length.

    ``shift[b]``: by how many words a window can move on whose last block has the hash ``b``.
    Windows are sorted by ``keys``; those of equal words are one, and ``places`` says where in
    ``text`` their words are. ``items[owners[w]:owners[w + 1]]`` are the items of window ``w``.
    """

    length: int
    width: int
    shift: np.ndarray
    keys: np.ndarray
    places: np.ndarray
    owners: np.ndarray
    items: np.ndarray
    text: bytes

    @classmethod
    def build(cls, words: Words, text: bytes, ends: np.ndarray, owner: np.ndarray,
              length: int) -> Machine:
        width = min(2, length)
        bits = max(12, int(len(ends) * 8).bit_length())
        shift = np.full(1 << bits, length - width + 1, np.uint8)
        mask = np.uint64(len(shift) - 1)
        for j in range(width - 1, length):  # later blocks allow smaller shifts
            shift[words.block(ends - length + 1 + j, width) & mask] = length - 1 - j
        keys = words.key(ends, length, width)
        order = np.lexsort((ends, keys))
        keys, ends, owner = keys[order], ends[order], owner[order]
        begin, end = words.begin[ends - length + 1].tolist(), words.end[ends].tolist()
        number, seen, last = np.empty(len(ends), np.int64), {}, None
        kept: list[int] = []
        for k, key in enumerate(keys.tolist()):
            if key != last:
                seen, last = {}, key
            number[k] = seen.setdefault(text[begin[k]:end[k]], len(kept))
            if number[k] == len(kept):
                kept.append(k)
        pairs = np.unique(np.stack([number, owner], axis=1), axis=0) if len(ends) else \
            np.empty((0, 2), np.int64)
        return cls(length, width, shift, keys[kept],
                   np.array([(begin[k], end[k]) for k in kept], np.int64).reshape(-1, 2),
                   np.searchsorted(pairs[:, 0], np.arange(len(kept) + 1)), pairs[:, 1], text)

    def candidates(self, words: Words) -> np.ndarray:
        """Ends of the windows of the texts whose last block is the last one of some test window.

        Every stretch of window ends has a pointer; all pointers move together, each by the shift
        of the block it sees, and pointers that have left their stretch go."""
        counts = words.counts - self.length + 1
        stretches = np.maximum(0, -(-counts // STRETCH))
        doc = np.repeat(np.arange(len(counts)), stretches)
        part = np.arange(len(doc)) - np.repeat(np.cumsum(stretches) - stretches, stretches)
        at = words.starts[doc] + self.length - 1 + part * STRETCH
        stop = np.minimum(at + STRETCH, (words.starts + words.counts)[doc])
        mask, found = np.uint64(len(self.shift) - 1), [np.empty(0, np.int64)]
        while len(at):
            step = self.shift[words.block(at, self.width) & mask].astype(np.int64)
            found.append(at[step == 0])
            at = at + np.maximum(step, 1)
            stays = at < stop
            at, stop = at[stays], stop[stays]
        return np.concatenate(found)

    def occurrences(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(end in the texts, window) of every occurrence, each confirmed by comparing the words."""
        at = self.candidates(words)
        key = words.key(at, self.length, self.width)
        low, high = np.searchsorted(self.keys, key), np.searchsorted(self.keys, key, "right")
        some = high > low
        at, low, many = at[some], low[some], (high - low)[some]
        ends, windows, data = [], [], words.data
        begin, end = words.begin[at - self.length + 1], words.end[at]
        sizes, total = self.places[:, 1] - self.places[:, 0], np.cumsum(many)
        for k in range(0, int(total[-1]) if len(at) else 0, COMPARED):
            # the candidates whose buckets begin in this part
            use = slice(*np.searchsorted(total - many, [k, k + COMPARED]))
            n = many[use]
            which = np.repeat(np.arange(use.start, use.stop), n)
            w = np.repeat(low[use] - np.cumsum(n) + n, n) + np.arange(n.sum())
            same = sizes[w] == (end - begin)[which]
            which, w = which[same], w[same]
            for e, a, b, v, p in zip(at[which].tolist(), begin[which].tolist(), end[which].tolist(),
                                     w.tolist(), self.places[w, 0].tolist(), strict=True):
                if data[a:b] == self.text[p:p + b - a]:
                    ends.append(e)
                    windows.append(v)
        return np.array(ends, np.int64), np.array(windows, np.int64)


def machines(ids: list[str | None], texts: list[str], window: int = WINDOW,
             ) -> tuple[list[Machine], list[str | None]]:
    """The machines of some test texts, one for each length of window, and the names of items."""
    words = Words(pa.array(texts, pa.large_string()))
    names = sorted({i for i in ids if i is not None}) + [None]
    numbers = {name: k for k, name in enumerate(names)}
    item = np.array([numbers[i] for i in ids], np.int64)
    text, out = bytes(words.data), []
    for length in range(1, window + 1):
        use = np.flatnonzero(words.counts >= length if length == window else words.counts == length)
        n = words.counts[use] - length + 1
        if len(use):
            start = np.repeat(words.starts[use] + length - 1 - np.cumsum(n) + n, n)
            out.append(Machine.build(words, text, start + np.arange(n.sum()),
                                     np.repeat(item[use], n), length))
    return out, names


def _pieces(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, texts in text_slices(batch, "text"):
            words = Words(texts)
            out: list[tuple[str | None, str]] = []
            for item, n, at in zip(part.column(0).to_pylist(), words.counts.tolist(),
                                   words.starts.tolist(), strict=True):
                for k in range(0, max(min(n, 1), n - window + 1), PIECE_WORDS):
                    last = at + min(n, k + PIECE_WORDS + window - 1) - 1
                    out.append((item, str(words.data[words.begin[at + k]:words.end[last]], "utf-8")))
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out],
                                                                     pa.string())], ["item", "text"])


def pattern_blocks(tests: DataFrame, item: str, text: str, window: int,
                   block_bytes: int) -> list[list[tuple[str | None, str]]] | Iterator:
    """The distinct pieces of the test set in blocks of at most ``block_bytes`` (and a piece)."""
    rows = tests.select(tests[item].cast("string").alias("item"), tests[text].alias("text"))
    pieces = cut(rows.mapInArrow(lambda b: _pieces(b, window), "item string, text string").distinct()
                 .withColumn("bytes", F.octet_length("text") + 1))
    total = pieces.agg(F.sum("bytes")).first()[0] or 0
    if total <= block_bytes:
        return [[(r.item, r.text) for r in pieces.collect()]]
    # the rows of a block stand together: their order decides nothing else
    placed = cut(running_sum(pieces, [], ["item", "text"], "bytes", "sum", cut).withColumn(
        "block", F.floor(F.col("sum") / block_bytes)))
    numbers = [r.block for r in placed.select("block").distinct().orderBy("block").collect()]
    return ([(r.item, r.text) for r in placed.where(F.col("block") == b).collect()] for b in numbers)


FOUND = ("n_words long, hits array<struct<start: long, length: long>>, items array<string>")
_SPAN = pa.struct([("start", pa.int64()), ("length", pa.int64())])


def _search(texts: pa.Array, found: tuple[list[Machine], list[str | None]],
            ) -> tuple[pa.Array, pa.Array, pa.Array]:
    words = Words(texts)
    tables, names = found
    n = len(texts)
    marks = np.zeros(len(words.size) + 1, np.int64)
    owned = [np.empty((0, 2), np.int64)]
    for table in tables:
        ends, windows = table.occurrences(words)
        np.add.at(marks, ends - table.length + 1, 1)
        np.add.at(marks, ends + 1, -1)
        doc = np.searchsorted(words.starts + words.counts, ends, "right")
        pairs = np.unique(np.stack([doc, windows], axis=1), axis=0)
        many = table.owners[pairs[:, 1] + 1] - table.owners[pairs[:, 1]]
        places = np.repeat(table.owners[pairs[:, 1]] - np.cumsum(many) + many, many)
        owned.append(np.unique(np.stack([np.repeat(pairs[:, 0], many), table.items[
            places + np.arange(many.sum())]], axis=1), axis=0))
    owned = np.unique(np.concatenate(owned), axis=0)
    owned = owned[owned[:, 1] < len(names) - 1]  # items without an id have no name
    hit = np.cumsum(marks)[:-1] > 0
    # a stretch of hit words ends where its document ends
    first = hit.copy()
    first[1:] &= ~hit[:-1]
    edges = words.starts[(words.counts > 0)]
    first[edges] = hit[edges]
    start = np.flatnonzero(first)
    length = np.diff(np.concatenate([np.cumsum(hit)[start] - 1, [hit.sum()]])) if len(start) else start
    doc = np.searchsorted(words.starts + words.counts, start, "right")
    spans = pa.ListArray.from_arrays(
        pa.array(np.searchsorted(doc, np.arange(n + 1)), pa.int32()), pa.StructArray.from_arrays(
            [pa.array(start - words.starts[doc], pa.int64()), pa.array(length, pa.int64())],
            fields=list(_SPAN)))
    items = pa.ListArray.from_arrays(
        pa.array(np.searchsorted(owned[:, 0], np.arange(n + 1)), pa.int32()),
        pa.array(names, pa.string()).take(pa.array(owned[:, 1])))
    return pa.array(words.counts, pa.int64()), spans, items


def find_passages(docs: DataFrame, tests: DataFrame, text: str = "text", item: str = "item_id",
                  test_text: str = "text", keep: list[str] | None = None, window: int = WINDOW,
                  block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Columns ``keep`` (default: all) of ``docs``, then ``n_words``, ``hits`` and ``items``.

    Words: runs of ASCII letters and digits and of non-ASCII characters, A-Z lower-cased. A window
    is ``window`` consecutive words of a test item, or all words of a shorter one. ``hits``: the
    maximal stretches (start, length) of words inside occurrences of windows; ``items``: the sorted
    ids, as text, of the items that have an occurring window.

    The windows become shift tables, which are broadcast and searched in one narrow pass over the
    documents. A test set beyond ``block_bytes`` is cut into blocks; each is broadcast alone, in
    its own pass, and the blocks' findings (rows of hit texts only) are united by a hash of the text.

    Null, empty and wordless texts have no words; such items no windows. Items of equal text all
    count; repeated rows of an item count once; hits of an item without id stand, but it is in no
    ``items``. Columns of ``docs`` named like an output must not be in ``keep``.
    """
    out = [c.split()[0] for c in ("n_words", "hits", "items")]
    keep = [c for c in docs.columns if c not in out] if keep is None else keep
    blocks = pattern_blocks(tests, item, test_text, window, block_bytes)
    rows = docs.select(*[docs[c].alias(f"k_{c}") for c in keep], docs[text].alias("_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1])

    def searched(df: DataFrame, block: list[tuple[str | None, str]], schema: str) -> DataFrame:
        table = df.sparkSession.sparkContext.broadcast(
            machines([b[0] for b in block], [b[1] for b in block], window))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, texts in text_slices(batch, "_text"):
                    yield pa.RecordBatch.from_arrays(
                        [*part.columns[:-1], *_search(texts, table.value)],
                        [*part.schema.names[:-1], *out])

        return df.mapInArrow(run, f"{schema}, {FOUND}" if schema else FOUND)

    back = [F.col(f"k_{c}").alias(c) for c in keep]
    if isinstance(blocks, list):
        return searched(rows, blocks[0], fields).select(*back, *out)
    texts = docs.select(*digest(docs[text]), docs[text].alias("_text"))
    parts = [cut(searched(texts, block, "t1 long, t2 long").where(F.size("hits") > 0).select(
        "t1", "t2", "hits", "items").dropDuplicates(["t1", "t2"])) for block in blocks]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    found = found.groupBy("t1", "t2").agg(
        F.flatten(F.collect_list("hits")).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    found = found.select("t1", "t2", _united("hits").alias("hits"), "items", F.explode(
        F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    # the count of words needs no table
    counted = searched(rows.select("*", *digest(F.col("_text")), (
        F.monotonically_increasing_id() % SALTS).cast("int").alias("salt"),
                                   F.col("_text").alias("_again"))
                       .drop("_text").withColumnRenamed("_again", "_text"), [],
                       ", ".join(x for x in (fields, "t1 long, t2 long, salt int") if x))
    return counted.drop("hits", "items").join(found, ["t1", "t2", "salt"], "left").select(
        *back, "n_words", *(F.coalesce(F.col(c), F.array().cast(t)).alias(c) for c, t in (
            ("hits", "array<struct<start: bigint, length: bigint>>"), ("items", "array<string>"))))


def _united(spans: str):
    """Stretches that touch or overlap as one, in order."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.named_struct(
        F.lit("start"), s["start"], F.lit("stop"), s["start"] + s["length"])))
    empty = F.array().cast("array<struct<start: bigint, stop: bigint>>")

    def add(done, s):
        last = F.try_element_at(done, F.lit(-1))
        joins = (F.size(done) > 0) & (s["start"] <= last["stop"])
        return F.when(joins, F.concat(
            F.slice(done, F.lit(1), F.size(done) - 1),
            F.array(F.named_struct(F.lit("start"), last["start"], F.lit("stop"),
                                   F.greatest(last["stop"], s["stop"]))))).otherwise(
            F.concat(done, F.array(s)))

    return F.transform(F.aggregate(ordered, empty, add), lambda s: F.named_struct(
        F.lit("start"), s["start"], F.lit("length"), s["stop"] - s["start"]))


def op12_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of operator 12: words, hit words and items of every document."""
    found = find_passages(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"),
                          keep=["doc_id"])
    hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, s: a + s["length"])
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"))
