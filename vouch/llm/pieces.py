"""SentencePiece encoding and decoding by best total score; giant texts by a max-plus scan."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vouch.llm.common import read, text_bytes, text_slices
from vouch.operators.lineage import cut

#: Characters of a chunk; longer texts are split.
CHUNK = 1 << 16
#: Text bytes encoded in one step; the ids as numbers of Python take about 15 times as much.
STEP_BYTES = 1 << 20
#: Characters up to which the distinct words of a step are segmented all at once.
SHORT = 64
#: Characters of words that are segmented at once, about; their pieces take some 300 bytes each.
AT_ONCE = 1 << 18
#: Segmented words that a task remembers.
REMEMBERED = 150_000
UNIT = re.compile(" +[^ ]*")
LOW = float("-inf")
#: Ids from here on stand for one character without a piece, by code point, before it is bytes.
UNKNOWN = 1 << 24


def default_model() -> str:
    """Place of the public piece model that is installed beside the libraries."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def rank_score(rank: int) -> float:
    """Log probability by rank, in whole 1 / 256, so that sums are exact in any order."""
    return -round(256 * (math.log(rank + 2.7) + 9.4)) / 256


@dataclass
class Pieces:
    """A vocabulary: text and score of each piece, with spaces as they are in texts.

    ``steps`` has every front part of a piece; its value is (id, score), or None if it is not a
    piece itself. ``split`` says that no piece has a space after another character, so that
    segments of words are independent.
    """

    steps: dict[str, tuple[int, float] | None]
    texts: list[bytes]
    byte_ids: np.ndarray
    is_byte: np.ndarray
    longest: int
    penalty: float
    split: bool
    remembered: dict[str, list[int]] = field(default_factory=dict)
    tables: tuple[np.ndarray, ...] | None = None

    @classmethod
    def load(cls, path: str, by_rank: bool = True) -> Pieces:
        """``by_rank``: the file has merge ranks, not log probabilities, as its scores; each piece
        then gets the log probability that its rank has under Zipf's law."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        steps: dict[str, tuple[int, float] | None] = {}
        texts, byte_ids, scores = [], np.zeros(256, np.int32), []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                byte_ids[int(piece[3:5], 16)] = i
                texts.append(bytes([int(piece[3:5], 16)]))
                continue
            if model.is_unknown(i) or model.is_control(i) or model.is_unused(i):
                texts.append(b"")
                continue
            piece = piece.replace("▁", " ")
            score = rank_score(len(scores)) if by_rank else float(model.get_score(i))
            texts.append(piece.encode())
            scores.append(score)
            for k in range(1, len(piece)):
                steps.setdefault(piece[:k], None)
            steps[piece] = (i, score)
        longest = max(map(len, steps))
        split = not any(" " in p.lstrip(" ") for p in steps)
        # a character without a piece costs more than the least of all proper scores
        is_byte = np.zeros(len(texts), bool)
        is_byte[byte_ids] = True
        return cls(steps, texts, byte_ids, is_byte, longest, min(scores) - 10, split)

    def forward(self, text: str, best: list[float], stop: int, start: int = 0,
                ) -> tuple[list[int], list[int]]:
        """Complete ``best`` (score of the best way to each position) over the pieces that start
        before ``stop``; returns the start and id of the last piece of each way. Of equal ways the
        one with the longer last piece holds. A character that is no piece is an edge of its own,
        so that every position can be reached."""
        n, longest, step = len(text), self.longest, self.steps.get
        back, ids = [-1] * (n + 1), [-1] * (n + 1)
        for i in range(start, stop):
            here = best[i]
            if here == LOW:
                continue
            found = step(text[i:i + 1])
            if not found:
                found = (UNKNOWN + ord(text[i]), self.penalty)
            j = i + 1
            last = min(i + longest, n)
            while True:
                if found:
                    score = here + found[1]
                    if score > best[j]:
                        best[j], back[j], ids[j] = score, i, found[0]
                j += 1
                if j > last:
                    break
                found = step(text[i:j], 0)
                if found == 0:
                    break
        return back, ids

    def segment(self, text: str) -> list[int]:
        """Edges of the best way through a text."""
        back, ids = self.forward(text, [0.0] + [LOW] * len(text), len(text))
        out, at = [], len(text)
        while at > 0:
            out.append(ids[at])
            at = back[at]
        out.reverse()
        return out

    def _tables(self) -> tuple[np.ndarray, ...]:
        """The tree of front parts as arrays: a hash table of (part, next character) with the longer
        part, and each part's id (-1: no piece) and score. Part 0 is empty."""
        if self.tables is None:
            number = {"": 0} | {part: k for k, part in enumerate(self.steps, 1)}
            keys = np.array([number[part[:-1]] << 21 | ord(part[-1]) for part in self.steps], np.int64)
            found = [(-1, 0.0), *(v or (-1, 0.0) for v in self.steps.values())]
            bits = max(4, int(len(keys) * 8).bit_length())
            slots, longer = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int64)
            left, at = np.arange(len(keys)), _slot(keys, bits)
            while len(left):
                free = slots[at] < 0
                slots[at[free]] = keys[left[free]]  # of several that want a slot the last one has it
                done = slots[at] == keys[left]
                longer[at[done]] = left[done] + 1
                left, at = left[~done], (at[~done] + 1) & ((1 << bits) - 1)
            self.tables = (slots, longer, np.array([f[0] for f in found], np.int64),
                           np.array([f[1] for f in found]))
        return self.tables

    def segment_all(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """``segment`` of all words together: their edges one after the other, and each one's number.

        The pieces that start at each character are found by going down the tree for all characters
        at once; then the best ways are completed place by place, for all words at once.
        """
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        text = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        slots, longer, piece, score = self._tables()
        ends = np.repeat(np.cumsum(sizes), sizes)
        at, part, size, edges = np.arange(len(text)), np.zeros(len(text), np.int64), 0, []
        while len(at):
            part = _look_up(slots, longer, part << 21 | text[at + size])
            size += 1
            if size == 1:
                odd = at[piece[part] < 0]
                edges.append((odd, np.ones(len(odd), np.int64), UNKNOWN + text[odd], np.full(len(odd), self.penalty)))
            hit = piece[part] >= 0
            edges.append((at[hit], np.full(int(hit.sum()), size), piece[part[hit]], score[part[hit]]))
            on = (part > 0) & (at + size < ends[at])
            at, part = at[on], part[on]
        start, size, ids, scores = (np.concatenate([e[k] for e in edges]) for k in range(4))
        # a word has a place more than characters
        number = np.repeat(np.arange(len(words)), sizes)
        first = np.cumsum(sizes) - sizes
        place = start - first[number[start]]
        start += number[start]
        order = np.argsort(place, kind="stable")
        start, stop, ids, scores = start[order], (start + size)[order], ids[order], scores[order]
        best = np.full(len(text) + len(words), LOW)
        best[first + np.arange(len(words))] = 0.0
        back, last = np.full(len(best), -1, np.int64), np.full(len(best), -1, np.int64)
        cuts = np.concatenate([[0], np.cumsum(np.bincount(place))])
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):  # the places that are reached are all different
            reached = best[start[a:b]] + scores[a:b]
            better = np.flatnonzero(reached > best[stop[a:b]])
            to = stop[a:b][better]
            best[to], back[to], last[to] = reached[better], start[a:b][better], ids[a:b][better]
        now, whose, ways = np.cumsum(sizes + 1) - 1, np.arange(len(words)), []
        while len(now):
            on = back[now] >= 0
            now, whose = now[on], whose[on]
            ways.append((whose, last[now]))
            now = back[now]
        whose, way = (np.concatenate([w[k] for w in reversed(ways)]) if ways else np.empty(0, np.int64)
                      for k in range(2))
        return way[np.argsort(whose, kind="stable")], np.bincount(whose, minlength=len(words))

    def word(self, unit: str) -> list[int]:
        found = self.remembered.get(unit)
        if found is None:
            if len(self.remembered) >= REMEMBERED:
                self.remembered.clear()
            found = self.remembered[unit] = self.segment(unit)
        return found

    def encode(self, text: str) -> list[int]:
        """Edges of a whole text, which gets a space in front."""
        if not text:
            return []
        text = " " + text
        if not self.split:
            return self.segment(text)
        out: list[int] = []
        for unit in UNIT.findall(text):
            out += self.word(unit)
        return out

    def transfer(self, text: str, stop: int, last: bool) -> np.ndarray:
        """Matrix of a chunk: best score from each entry (characters of the chunk that a piece
        from the chunk before covers) to each exit (characters that the last piece covers of the
        next chunk). ``text`` goes on beyond the chunk's end, ``stop``, as far as a piece can."""
        size = self.longest
        out = np.full((size, size), LOW)
        exits = 1 if last else min(size, len(text) - stop + 1)
        # behind the first place that no piece spans, all entries share one way
        join = next((p for p in range(size, stop) if text[p] == " " and text[p - 1] != " "),
                    stop) if self.split else stop
        shared = None
        if join < stop:
            best = [LOW] * (len(text) + 1)
            best[join] = 0.0
            self.forward(text, best, stop, join)
            shared = np.array([best[stop + x] for x in range(exits)])
        for e in range(min(size, stop + 1)):
            head = text if shared is None else text[:join]
            best = [LOW] * (len(head) + 1)
            best[e] = 0.0
            self.forward(head, best, stop if shared is None else join, e)
            out[e, :exits] = [best[stop + x] for x in range(exits)] if shared is None \
                else best[join] + shared
        return out

    def trace(self, text: str, stop: int, entries: np.ndarray, last: bool,
              ) -> dict[int, tuple[int, list[int]]]:
        """With the scores of all entries known: for each exit that can be reached, the entry that
        its best way comes from and the edges on the way."""
        best = [LOW] * (len(text) + 1)
        best[:len(entries)] = entries[:len(best)].tolist()
        fixed = len(entries)
        back, ids = self.forward(text, best, stop)
        out = {}
        for x in range(1 if last else min(fixed, len(text) - stop + 1)):
            at, way = stop + x, []
            if best[at] == LOW:
                continue
            while back[at] >= 0:
                way.append(ids[at])
                at = back[at]
            out[x] = (at, way[::-1])
        return out

    def ids(self, edges: list[int]) -> np.ndarray:
        """Piece ids: characters without a piece become their bytes."""
        a = np.array(edges, np.int32)
        odd = np.flatnonzero(a >= UNKNOWN)
        if not len(odd):
            return a
        parts, at = [], 0
        for k in odd.tolist():
            parts += [a[at:k], self.byte_ids[list(chr(int(a[k]) - UNKNOWN).encode())]]
            at = k + 1
        return np.concatenate([*parts, a[at:]]).astype(np.int32)

    def decode(self, ids: list[int]) -> bytes:
        """UTF-8 of the pieces, still with the space in front of the text."""
        return b"".join(map(self.texts.__getitem__, ids))


def _slot(keys: np.ndarray, bits: int) -> np.ndarray:
    return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def _look_up(slots: np.ndarray, values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The values of the keys in a hash table, 0 for those that it does not hold."""
    at = _slot(keys, len(slots).bit_length() - 1)
    there = slots[at]
    out = np.where(there == keys, values[at], 0)
    left = np.flatnonzero((there != keys) & (there >= 0))
    while len(left):
        at[left] = (at[left] + 1) & (len(slots) - 1)
        there = slots[at[left]]
        out[left] = np.where(there == keys[left], values[at[left]], 0)
        left = left[(there != keys[left]) & (there >= 0)]
    return out


def _segmented(pieces: Pieces, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Edges of all words, one word after the other, and each one's number: the short words all at
    once, each long one by itself."""
    short = np.fromiter((len(w) <= SHORT for w in words), bool, len(words))
    few = [w for w, s in zip(words, short.tolist(), strict=True) if s]
    block = np.cumsum(np.fromiter(map(len, few), np.int64, len(few))) // AT_ONCE
    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(few)]
    parts = [pieces.segment_all(few[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if a < b]
    way, n = (np.concatenate([np.empty(0, np.int64), *(x[k] for x in parts)]) for k in range(2))
    if short.all():
        return way, n
    long = [pieces.segment(words[k]) for k in np.flatnonzero(~short).tolist()]
    numbers = np.empty(len(words), np.int64)
    numbers[short], numbers[~short] = n, list(map(len, long))
    out = np.empty(int(numbers.sum()), np.int64)
    here = np.repeat(short, numbers)
    out[here], out[~here] = way, np.fromiter(chain.from_iterable(long), np.int64, int(numbers[~short].sum()))
    return out, numbers


def multiply(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product of matrices (or stacks of them)."""
    return (a[..., :, :, None] + b[..., None, :, :]).max(axis=-2)


def scan(matrices: np.ndarray) -> np.ndarray:
    """Products of the first 1, 2, ... matrices, by pairs: the product is associative, so an even
    and its odd neighbour are combined and the half as long rest is scanned."""
    n = len(matrices)
    if n < 2:
        return matrices.copy()
    pairs = multiply(matrices[0:n - n % 2:2], matrices[1:n:2])
    odd = scan(pairs)
    out = np.empty_like(matrices)
    out[0], out[1::2] = matrices[0], odd
    out[2::2] = multiply(odd[:(n - 1) // 2], matrices[2::2])
    return out


def digest(edges: list[int], start: int, lengths: np.ndarray) -> int:
    """Order-free sum over edges of a mix of where each starts and what it is: the sums of the
    chunks of a text add up to that of the text."""
    a = np.array(edges, np.int64)
    size = np.where(a < UNKNOWN, lengths[np.minimum(a, len(lengths) - 1)], 1)
    return int(mix(start + np.cumsum(size) - size, a).sum())


def mix(at: np.ndarray, a: np.ndarray) -> np.ndarray:
    """A 32-bit number for each place and edge."""
    x = (at.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (a.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9))
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(32)).astype(np.int64)


COUNTED = "n_pieces long, n_bytes long, ids_digest long, round_trip boolean"


def _count(pieces: Pieces, edges: list[int], text: str, start: int, lengths: np.ndarray) -> tuple:
    ids = pieces.ids(edges)
    listed = ids.tolist()
    return (len(ids), int(pieces.is_byte[ids].sum()), digest(edges, start, lengths),
            pieces.decode(listed) == text.encode(), listed)


def _places(sizes: np.ndarray, starts: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Places of the entries of the lists ``which``, one list after the other."""
    n = sizes[which]
    return np.repeat(starts[which] - np.cumsum(n) + n, n) + np.arange(n.sum())


def _encoded(pieces: Pieces, texts: pa.Array, lengths: np.ndarray) -> list[pa.Array]:
    """``COUNTED`` and ids of whole texts: each distinct word of the texts is segmented once."""
    empty = pc.equal(pc.binary_length(texts), 0)
    data, bounds = text_bytes(pc.if_else(empty, "", pc.binary_join_element_wise(" ", texts, "")))
    begins = np.zeros(len(data), bool)
    if pieces.split and len(data):
        begins[1:] = (data[1:] == 0x20) & (data[:-1] != 0x20)
    begins[bounds[:-1][bounds[:-1] < bounds[1:]]] = True
    places = np.flatnonzero(begins)
    words = pa.Array.from_buffers(pa.large_string(), len(places), [
        None, pa.py_buffer(np.append(places, len(data)).astype(np.int64)),
        pa.py_buffer(np.ascontiguousarray(data))])
    codes = pc.dictionary_encode(words)
    which = codes.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    distinct = codes.dictionary.to_pylist()
    flat, n_edges = _segmented(pieces, distinct)
    # characters without a piece become their bytes
    odd = np.flatnonzero(flat >= UNKNOWN)
    raw = [chr(int(flat[k]) - UNKNOWN).encode() for k in odd.tolist()]
    each = np.ones(len(flat), np.int64)
    each[odd] = [len(r) for r in raw]
    flat_ids = np.repeat(np.where(flat < UNKNOWN, flat, 0), each)
    where = np.cumsum(each) - each
    flat_ids[_places(each[odd], where[odd], np.arange(len(odd)))] = pieces.byte_ids[
        np.frombuffer(b"".join(raw), np.uint8)]

    def per_word(of_id: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(of_id)])[np.concatenate([[0], np.cumsum(each)])]
        ends = np.concatenate([[0], np.cumsum(n_edges)])
        return total[ends[1:]] - total[ends[:-1]]

    n_ids = per_word(np.ones(len(flat_ids), np.int64))
    n_bytes = per_word(pieces.is_byte[flat_ids].astype(np.int64))
    want = [w.encode() for w in distinct]
    decoded = list(map(pieces.texts.__getitem__, flat_ids.tolist()))
    back = per_word(np.fromiter(map(len, decoded), np.int64, len(decoded))) == np.fromiter(
        map(len, want), np.int64, len(want))
    if b"".join(decoded) != b"".join(want):
        ends = np.cumsum(n_ids).tolist()
        back = np.array([b"".join(decoded[e - n:e]) == w
                         for e, n, w in zip(ends, n_ids.tolist(), want, strict=True)], bool)
    word_starts = np.searchsorted(places, bounds)

    def per_text(of_word: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(of_word[which])])
        return total[word_starts[1:]] - total[word_starts[:-1]]

    way = flat[_places(n_edges, np.cumsum(n_edges) - n_edges, which)]
    ends = np.concatenate([[0], np.cumsum(per_text(n_edges))])
    size = np.where(way < UNKNOWN, lengths[np.minimum(way, len(lengths) - 1)], 1)
    at = np.concatenate([[0], np.cumsum(size)])
    at = at[:-1] - np.repeat(at[ends[:-1]], np.diff(ends))
    mixed = np.concatenate([[0], np.cumsum(mix(at, way))])
    counts = per_text(n_ids)
    listed = flat_ids[_places(n_ids, np.cumsum(n_ids) - n_ids, which)]
    return [pa.array(counts), pa.array(per_text(n_bytes)), pa.array(mixed[ends[1:]] - mixed[ends[:-1]]),
            pa.array(per_text((~back).astype(np.int64)) == 0),
            pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()),
                                     pa.array(listed, pa.int32()))]


def _lengths(pieces: Pieces) -> np.ndarray:
    return np.array([len(t.decode("utf-8", "replace")) for t in pieces.texts], np.int64)


def encode(docs: DataFrame, text: str = "text", keep: list[str] | None = None,
           model: str | None = None, chunk: int = CHUNK, with_ids: bool = True) -> DataFrame:
    """Columns ``keep`` (default: all), then ``COUNTED`` and with ``with_ids`` the piece ids.

    The segmentation has the greatest sum of the pieces' scores in ``model``; characters without a
    piece become bytes, so that decoding gives back every text (``round_trip`` compares the decoded
    bytes). Null and empty texts have no pieces. The vocabulary (under 2 MB, fixed by the model
    file) is read by the driver and broadcast.

    Texts of up to ``chunk`` characters are one narrow pass. Longer ones are split, whatever stands
    at the borders: each chunk gives a matrix of best scores between the states of its two borders,
    the matrices of a text are combined by an associative scan, and with the border scores known
    each chunk traces its way back by itself. The result is the same as without splitting. Columns
    of the input named like an output must not be in ``keep``.
    """
    names = [c.split()[0] for c in COUNTED.split(", ")] + ["ids"]
    keep = [c for c in docs.columns if c not in names] if keep is None else keep
    pieces = Pieces.load(model or default_model())
    shared = docs.sparkSession.sparkContext.broadcast((pieces, _lengths(pieces)))
    rows = docs.select(*[docs[c].alias(f"k_{c}") for c in keep],
                       F.coalesce(docs[text], F.lit("")).alias("_text"))
    giant = F.char_length("_text") > chunk
    kept = [f"k_{c}" for c in keep]
    extra = ", ids array<int>" * with_ids
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, lengths = shared.value
        for batch in batches:
            for part, texts in text_slices(batch, "_text", STEP_BYTES):
                columns = _encoded(vocabulary, texts, lengths)[:4 + with_ids]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *columns],
                                                 [*part.schema.names[:-1], *names[:len(columns)]])

    small = rows.where(~giant).mapInArrow(run, ", ".join([*fields, COUNTED]) + extra)
    large = _giants(rows.where(giant), kept, shared, pieces.longest, chunk, with_ids)
    return small.unionByName(large).select(*[F.col(f"k_{c}").alias(c) for c in keep],
                                           *names[:4 + with_ids])


def _giants(rows: DataFrame, kept: list[str], shared, size: int, chunk: int,
            with_ids: bool) -> DataFrame:
    if chunk < size:
        raise ValueError("a chunk must be at least as long as the longest piece")
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()))
    # a text has one character more than it shows: the space in front
    spaced = rows.select("row", F.concat(F.lit(" "), F.col("_text")).alias("t")).withColumn(
        "n", F.ceil(F.char_length("t") / chunk).cast("int"))
    # chunks are dealt anew, so that those of one text go to many tasks
    chunks = spaced.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select(
        "row", "k", (F.col("k") == F.col("n") - 1).alias("last"),
        F.substring("t", F.col("k") * chunk + 1, F.lit(chunk + size - 1)).alias("t"))
    chunks = cut(chunks.repartition("row", "k"))

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, _ = shared.value
        for batch in batches:
            for part, texts in text_slices(batch, "t"):
                made = [pieces.transfer(t, min(chunk, len(t)), last).tobytes() for t, last in zip(
                    texts.to_pylist(), part.column(2).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(made)],
                                                 ["row", "k", "matrix"])

    def entries(table: pa.Table) -> pa.Table:
        """Scores of all entries of each chunk of a text: the first row of the products so far."""
        table = table.sort_by("k")
        m = np.stack([np.frombuffer(b).reshape(size, size)
                      for b in table.column("matrix").to_pylist()])
        before = np.concatenate([np.array([[0.0] + [LOW] * (size - 1)]), scan(m)[:-1, 0, :]])
        return pa.table([table.column("row"), table.column("k"),
                         pa.array([e.tobytes() for e in before])], names=["row", "k", "entries"])

    def traces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, _ = shared.value
        for batch in batches:
            for part, texts in text_slices(batch, "t"):
                out = [[], [], [], [], []]
                for row, k, last, entry, t in zip(
                        part.column(0).to_pylist(), part.column(1).to_pylist(),
                        part.column(2).to_pylist(), part.column(3).to_pylist(), texts.to_pylist(),
                        strict=True):
                    ways = pieces.trace(t, min(chunk, len(t)), np.frombuffer(entry), last)
                    for x, (e, way) in ways.items():
                        for column, value in zip(out, (row, k, x, e, way), strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, kind) for c, kind in zip(out, (
                        pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int32())),
                        strict=True)], ["row", "k", "exit", "entry", "way"])

    def chosen(table: pa.Table) -> pa.Table:
        """The exit of each chunk of a text, from the last chunk back: it is the next one's entry."""
        entry = {(k, x): e for k, x, e in zip(table.column("k").to_pylist(),
                                              table.column("exit").to_pylist(),
                                              table.column("entry").to_pylist(), strict=True)}
        at, out = 0, []
        for k in range(max(k for k, _ in entry), -1, -1):
            out.append((k, at))
            at = entry[k, at]
        return pa.table([pa.array([table.column("row")[0].as_py()] * len(out), pa.int64()),
                         pa.array([k for k, _ in out], pa.int32()),
                         pa.array([x for _, x in out], pa.int32())], names=["row", "k", "exit"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, lengths = shared.value
        for batch in batches:
            for part, texts in text_slices(batch, "t"):
                out = [_count(pieces, way, t[e:min(chunk, len(t)) + x], k * chunk + e, lengths)
                       for k, x, e, way, t in zip(
                           *(part.column(c).to_pylist() for c in ("k", "exit", "entry", "way")),
                           texts.to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), *(
                        pa.array([o[i] for o in out], kind) for i, kind in enumerate(
                            [pa.int64()] * 3 + [pa.bool_(), pa.list_(pa.int32())]))],
                    ["row", "k", "n_pieces", "n_bytes", "ids_digest", "round_trip", "ids"])

    scored = chunks.mapInArrow(matrices, "row long, k int, matrix binary").groupBy("row") \
        .applyInArrow(entries, "row long, k int, entries binary")
    traced = cut(chunks.join(scored, ["row", "k"]).select("row", "k", "last", "entries", "t")
                 .mapInArrow(traces, "row long, k int, exit int, entry int, way array<int>"))
    picked = traced.select("row", "k", "exit", "entry").groupBy("row").applyInArrow(
        chosen, "row long, k int, exit int")
    ways = traced.join(picked, ["row", "k", "exit"]).join(chunks.select("row", "k", "t"), ["row", "k"])
    found = ways.select("row", "k", "exit", "entry", "way", "t").mapInArrow(
        counted, f"row long, k int, {COUNTED}, ids array<int>")
    sums = [F.sum("n_pieces").alias("n_pieces"), F.sum("n_bytes").alias("n_bytes"),
            F.sum("ids_digest").alias("ids_digest"), F.min("round_trip").alias("round_trip")]
    if with_ids:  # a text's own pieces, no more than a text itself
        sums.append(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("k", "ids"))),
                                          lambda s: s["ids"])).alias("ids"))
    return rows.select("row", *kept).join(found.groupBy("row").agg(*sums), "row").drop("row")


def decode(encoded: DataFrame, ids: str = "ids", out: str = "decoded", model: str | None = None,
           ) -> DataFrame:
    """Adds the text of the piece ids as column ``out`` (null ids: null)."""
    pieces = Pieces.load(model or default_model())
    shared = encoded.sparkSession.sparkContext.broadcast(pieces)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema]
    place = encoded.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if i is None else shared.value.decode(i)[1:].decode("utf-8", "replace")
                     for i in batch.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())],
                                             [*batch.schema.names, out])

    return encoded.mapInArrow(run, ", ".join([*fields, f"`{out}` string"]))


def op7_max_plus_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded: doc_id, pieces, byte pieces, digest, round trip."""
    return encode(read(spark, sf_dir, "documents"), keep=["doc_id"], with_ids=False)
