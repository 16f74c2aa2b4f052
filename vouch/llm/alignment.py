"""Which tokens of two tokenizers cover the same bytes: lockstep merging of their ends."""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vouch.llm.common import read, text_bytes, text_slices
from vouch.operators.lineage import shared_folder

#: Text bytes of a block: the unit of Python work and of the exchange of counts.
#: Its arrays take about 80 times as much.
BLOCK_BYTES = 2 << 20
#: Tokens of A that one pointer pair looks after.
STRETCH = 64
#: Pieces of text that a tokenizer gets at once.
BATCH = 4096


def default_models() -> tuple[str, str]:
    """Places of the public byte-level file (A) and piece file (B)."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def byte_letters() -> dict[str, int]:
    """The letter of each byte in byte-level vocabularies: printable bytes stand for themselves,
    the others, in order, for the letters from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(others)}


def rank_encoder(path: str):
    """An encoder by ranks for a byte-level file whose merges have the ids' order and whose texts
    are split by the public pattern (the same ids at a quarter of the time); else None."""
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as file:
        held = json.load(file)
    vocab, merges = held["model"].get("vocab"), held["model"].get("merges")
    split, letters = held.get("pre_tokenizer") or {}, byte_letters()
    if held.get("normalizer") or merges is None or split.get("type") != "ByteLevel" \
            or split.get("add_prefix_space") or not split.get("use_regex", True):
        return None
    joined = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in merges]
    if any(vocab.get(m) != 256 + k for k, m in enumerate(joined)):
        return None
    ranks = {bytes(letters[c] for c in t): k for t, k in vocab.items() if k < 256 + len(merges)}
    return tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                             special_tokens={})


class Pair:
    """Two tokenizers, and the bytes of each of their tokens."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.a_ranks = rank_encoder(a_path)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        letters = byte_letters()
        self.a_bytes = [b""] * (max(self.a.get_vocab().values()) + 1)
        for token, k in self.a.get_vocab().items():
            self.a_bytes[k] = bytes(letters[c] for c in token) if all(c in letters for c in token) \
                else token.encode()
        self.b_bytes = []
        for k in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(k)
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(k)
                                else piece.replace("▁", " ").encode())
        self.a_sizes = np.array([len(t) for t in self.a_bytes], np.int64)
        self.b_sizes = np.array([len(t) for t in self.b_bytes], np.int64)
        # no piece goes on over a space, and no space is dropped: words can be encoded alone
        pieces = (self.b.id_to_piece(k) for k in range(self.b.get_piece_size()))
        self.blank = self.b.piece_to_id("▁")
        self.split = not any("▁" in p.lstrip("▁") for p in pieces) and b"".join(
            self.b_bytes[i] for i in self.b.encode("  a  b ")) == b"   a  b "

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(ids, number of ids of each text) of A and B for texts that begin with a space (B adds
        its own). Both have no ids where the tokens' bytes are not those of the text."""
        a_ids: list[list[int]] = []
        b_ids: list[list[int]] = []
        for k in range(0, len(texts), BATCH):
            part = texts[k:k + BATCH]
            if self.a_ranks is not None:
                a_ids += map(self.a_ranks.encode_ordinary, part)
            else:
                a_ids += [e.ids for e in self.a.encode_batch_fast(part, add_special_tokens=False)]
            b_ids += [i or [self.blank] for i in  # to B, a space alone is an empty text
                      self.b.encode([t[1:] for t in part], num_threads=1)]
        raw = [t.encode() for t in texts]
        want, whole, out = np.array([len(r) for r in raw], np.int64), b"".join(raw), []
        lost = np.zeros(len(texts), bool)
        for ids, of, sizes in ((a_ids, self.a_bytes, self.a_sizes),
                               (b_ids, self.b_bytes, self.b_sizes)):
            n = np.array([len(i) for i in ids], np.int64)
            flat = np.fromiter(chain.from_iterable(ids), np.int64, int(n.sum()))
            ends = np.concatenate([[0], np.cumsum(sizes[flat])])[np.cumsum(n)]
            if not np.array_equal(np.diff(ends, prepend=0), want) or \
                    b"".join(map(of.__getitem__, flat.tolist())) != whole:
                lost |= [b"".join(map(of.__getitem__, i)) != r
                         for i, r in zip(ids, raw, strict=True)]
            out.append((flat, n))
        if lost.any():
            out = [(flat[~np.repeat(lost, n)], np.where(lost, 0, n)) for flat, n in out]
        return out


_loaded: dict[tuple[str, str], Pair] = {}


def _pair(paths: tuple[str, str]) -> Pair:
    """The tokenizers of this worker; their tables have the size of their files."""
    if paths not in _loaded:
        _loaded.clear()
        _loaded[paths] = Pair(*paths)
    return _loaded[paths]


def parts_of(texts: pa.Array, split: bool) -> tuple[pa.Array, np.ndarray]:
    """The texts, a space before each, in parts that both tokenizers treat alone, and where each
    text's parts begin. A part begins at a space whose left neighbour is neither white space nor
    one of the characters (the ranges around them) that some libraries take for it."""
    data, bounds = text_bytes(pc.binary_join_element_wise(" ", texts, ""))
    begins = np.zeros(len(data), bool)
    if split and len(data):
        begins = data == 0x20
        padded = np.concatenate([np.zeros(3, np.uint8), data])
        one, two, three = padded[2:-1], padded[1:-2], padded[:-3]  # bytes to the left
        begins &= one > 0x20
        begins &= (one < 0x80) | ~((two == 0xC2) | np.isin(three, (0xE1, 0xE2, 0xE3, 0xEF)))
    full = bounds[:-1] < bounds[1:]
    begins[bounds[:-1][full]] = True
    places = np.flatnonzero(begins)
    offsets = pa.py_buffer(np.append(places, len(data)).astype(np.int64))
    parts = pa.Array.from_buffers(pa.large_string(), len(places), [None, offsets, pa.py_buffer(
        np.ascontiguousarray(data))])
    return parts, np.searchsorted(places, bounds)


def ragged(sizes: np.ndarray, starts: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Places of the entries of the lists ``which``, one list after the other."""
    n = sizes[which]
    return np.repeat(starts[which] - np.cumsum(n) + n, n) + np.arange(n.sum())


def lockstep(a_ends: np.ndarray, b_ends: np.ndarray, first: np.ndarray, stop: np.ndarray,
             ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(A token, B token) of every overlap, and of each whether both tokens end there.

    ``a_ends`` and ``b_ends``: where the tokens of all documents end in their bytes, one document
    after the other. A pair of pointers stands at the A token ``first`` and the B token that covers
    its first byte. In each step every pair emits its two tokens as a link; the pointer whose token
    ends earlier moves on, and where both end, which is a cut, both do. Pairs that reach ``stop`` go.
    """
    begin = np.where(first > 0, a_ends[np.maximum(first, 1) - 1], 0) if len(first) else first
    i, j = first, np.searchsorted(b_ends, begin, "right")
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(i):
        x, y = a_ends[i], b_ends[j]
        out.append((i, j, x == y))
        i, j = i + (x <= y), j + (y <= x)
        stays = i < stop
        if not stays.all():
            i, j, stop = i[stays], j[stays], stop[stays]
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
    return tuple(np.concatenate([o[k] for o in out]) for k in range(3))


@dataclass
class Aligned:
    """Tokens, links and cuts of the documents of a block, one document after the other."""

    a: np.ndarray
    b: np.ndarray
    a_starts: np.ndarray  # where each document's tokens begin, and the end
    b_starts: np.ndarray
    link_a: np.ndarray  # places in a and b
    link_b: np.ndarray
    link_starts: np.ndarray
    a_cut: np.ndarray  # whether a group ends with the token
    b_cut: np.ndarray


def aligned(texts: pa.Array, pair: Pair) -> Aligned:
    parts, bounds = parts_of(texts, pair.split)
    codes = pc.dictionary_encode(parts)
    which = codes.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    encoded = pair.encode(codes.dictionary.to_pylist())
    # a document with a part that does not come back from its tokens has no tokens; texts that
    # are empty have no more than the added space
    lost = np.concatenate([[0], np.cumsum((encoded[0][1] == 0)[which])])
    empty = pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    fine = (lost[bounds[1:]] == lost[bounds[:-1]]) & ~empty
    which = which[np.repeat(fine, np.diff(bounds))]
    counts = np.where(fine, np.diff(bounds), 0)
    starts = np.concatenate([[0], np.cumsum(counts)])
    tokens, token_starts = [], []
    for flat, size in encoded:
        tokens.append(flat[ragged(size, np.cumsum(size) - size, which)])
        token_starts.append(np.concatenate([[0], np.cumsum(size[which])])[starts])
    (a, b), (a_starts, b_starts) = tokens, token_starts
    n = np.diff(a_starts)
    stretches = -(-n // STRETCH)
    doc = np.repeat(np.arange(len(n)), stretches)
    first = a_starts[doc] + STRETCH * (
        np.arange(len(doc)) - np.repeat(np.cumsum(stretches) - stretches, stretches))
    stop = np.minimum(first + STRETCH, a_starts[doc + 1])
    i, j, both = lockstep(np.cumsum(pair.a_sizes[a]), np.cumsum(pair.b_sizes[b]), first, stop)
    a_cut, b_cut = np.zeros(len(a), bool), np.zeros(len(b), bool)
    a_cut[i[both]] = b_cut[j[both]] = True
    # links in the order of their tokens: the links of one A token are neighbours in B
    many = np.bincount(i, minlength=len(a))
    first_b = np.empty(len(a), np.int64)
    first_b[i[::-1]] = j[::-1]
    offsets = np.concatenate([[0], np.cumsum(many)])
    place = offsets[i] + j - first_b[i]
    link_a, link_b = np.empty(len(i), np.int64), np.empty(len(i), np.int64)
    link_a[place], link_b[place] = i, j
    return Aligned(a, b, a_starts, b_starts, link_a, link_b, offsets[a_starts], a_cut, b_cut)


def written_groups(x: Aligned) -> list[str]:
    """The lowercase hex SHA-256 of ``a1,a2|b1;a3|b2,b3`` for each document (no tokens: empty)."""
    a_group, b_group = np.cumsum(x.a_cut) - x.a_cut, np.cumsum(x.b_cut) - x.b_cut
    a_ends, b_ends = np.flatnonzero(x.a_cut) + 1, np.flatnonzero(x.b_cut) + 1
    a_place = np.arange(len(x.a)) + np.concatenate([[0], b_ends])[a_group]
    b_place = np.arange(len(x.b)) + a_ends[b_group]
    ids, mark = np.empty(len(x.a) + len(x.b), np.int64), np.empty(len(x.a) + len(x.b), np.uint8)
    ids[a_place], ids[b_place] = x.a, x.b
    mark[a_place] = np.where(x.a_cut, ord("|"), ord(","))
    mark[b_place] = np.where(x.b_cut, ord(";"), ord(","))
    digits = np.ones(len(ids), np.int64)
    for power in range(1, len(str(int(ids.max(initial=0))))):
        digits += ids >= 10 ** power
    ends = np.cumsum(digits + 1)
    text = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    text[ends - 1] = mark
    left, at, rest = digits, ends - 2, ids
    while len(at):
        text[at] = 48 + rest % 10
        more = left > 1
        left, at, rest = left[more] - 1, at[more] - 1, rest[more] // 10
    bounds = np.concatenate([[0], ends])[x.a_starts + x.b_starts].tolist()
    raw = memoryview(text)
    return [hashlib.sha256(raw[s:e - 1]).hexdigest() if e > s else ""
            for s, e in zip(bounds, bounds[1:], strict=False)]


COUNTED = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
TOKENS = ("a_ids array<int>, b_ids array<int>, links array<struct<a: int, b: int>>, "
          "cuts array<struct<a: int, b: int>>")


def _counted(x: Aligned) -> list[pa.Array]:
    cuts = np.concatenate([[0], np.cumsum(x.a_cut)])[x.a_starts]
    return [*(pa.array(np.diff(s), pa.int64()) for s in (x.a_starts, x.b_starts, cuts, x.link_starts)),
            pa.array(written_groups(x), pa.string())]


def _listed(x: Aligned) -> list[pa.Array]:
    def ints(values, of=pa.int32()):
        return pa.array(values, of)

    def pairs(starts, a, b):
        return pa.ListArray.from_arrays(ints(starts), pa.StructArray.from_arrays(
            [ints(a), ints(b)], ["a", "b"]))

    a_cuts, b_cuts = np.flatnonzero(x.a_cut), np.flatnonzero(x.b_cut)
    cuts = np.concatenate([[0], np.cumsum(x.a_cut)])[x.a_starts]
    of_link, of_cut = (np.repeat(np.arange(len(s) - 1), np.diff(s)) for s in (x.link_starts, cuts))
    return [pa.ListArray.from_arrays(ints(x.a_starts), ints(x.a)),
            pa.ListArray.from_arrays(ints(x.b_starts), ints(x.b)),
            pairs(x.link_starts, x.link_a - x.a_starts[of_link], x.link_b - x.b_starts[of_link]),
            pairs(cuts, a_cuts + 1 - x.a_starts[of_cut], b_cuts + 1 - x.b_starts[of_cut])]


def align(docs: DataFrame, text: str = "text", keep: list[str] | None = None,
          models: tuple[str, str] | None = None) -> DataFrame:
    """Columns ``keep`` (default: all), ``COUNTED`` and ``TOKENS``.

    A encodes a space and the text, B the text, to which it adds the space; strings of special
    tokens are plain text. ``links``: places of an A and a B token that share bytes; ``cuts``: how
    many tokens of A and B stand before each byte offset where both end (the ends of the groups).
    Null and empty texts, and texts that do not come back from the tokens of A or B, have no
    tokens: counts of zero, empty arrays and an empty ``groups_sha256``. One narrow pass. Columns
    of the input named like an output must not be in ``keep``.
    """
    paths = models or default_models()
    names = [c.split()[0] for c in COUNTED.split(", ")] + ["a_ids", "b_ids", "links", "cuts"]
    keep = [c for c in docs.columns if c not in names] if keep is None else keep
    df = docs.select(*[docs[c] for c in keep], docs[text].alias("_text"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch, "_text", BLOCK_BYTES):
                x = aligned(texts, _pair(paths))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *_counted(x), *_listed(x)],
                                                 [*part.schema.names[:-1], *names])

    return df.mapInArrow(run, ", ".join([*fields, COUNTED, TOKENS]))


def pack(numbers: np.ndarray) -> bytes:
    """Small numbers in few bytes: one plane of bytes after the other, compressed."""
    planes = numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return pa.Codec("zstd").compress(np.ascontiguousarray(planes), asbytes=True)


def unpack(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.Codec("zstd").decompress(data, 4 * n, asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).view("<u4").reshape(-1).astype(np.int64)


BLOCK = "pairs array<long>, pair_docs array<int>, sizes array<int>, packed binary"
_NO_BLOCK = (pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary())


def align_and_count(docs: DataFrame, text: str = "text", keep: list[str] | None = None,
                    models: tuple[str, str] | None = None, block_bytes: int = BLOCK_BYTES,
                    ) -> DataFrame:
    """Columns ``keep`` (default: all), ``COUNTED``, ``n_best`` and ``count_sum``.

    The count of an (A id, B id) is the number of documents that hold it linked. ``count_sum``: the
    counts of all links; ``n_best``: the links whose count is the highest of their A id (ties too).

    Texts are encoded and merged once, in blocks. A block leaves a row for each document and one
    row with the block's distinct id pairs, in how many of its documents each is, and its links as
    numbers of those pairs; this table lies in the shared folder. The pairs of all blocks are summed
    (combined before the shuffle; a pair has one row a block at most), the highest count of an A id
    is taken over its partners (at most the vocabulary of B), and each block gets back the counts
    of its own pairs, so nothing that grows with the corpus meets in one place.

    Repeated rows are documents of their own. Other odd cases are as in ``align``.
    """
    paths = models or default_models()
    out = [c.split()[0] for c in COUNTED.split(", ")] + ["n_best", "count_sum"]
    keep = [c for c in docs.columns if c not in out] if keep is None else keep
    df = docs.select(*[docs[c].alias(f"k_{c}") for c in keep], docs[text].alias("_text"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema[:-1]]
    many_b = len(Pair(*paths).b_bytes)
    columns = [c.split()[0] for c in f"{COUNTED}, {BLOCK}".split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part, texts in text_slices(batch, "_text", block_bytes):
                x = aligned(texts, _pair(paths))
                n = part.num_rows
                rows = [*part.columns[:-1], pa.array(np.full(n, number)), pa.array(np.arange(n)),
                        *_counted(x), *(pa.nulls(n, t) for t in _NO_BLOCK)]
                names = [*part.schema.names[:-1], "block", "place", *columns]
                yield pa.RecordBatch.from_arrays(rows, names)
                if len(x.link_a):
                    yield pa.RecordBatch.from_arrays(
                        [*(pa.nulls(1, c.type) for c in part.columns[:-1]), pa.array([number]),
                         pa.nulls(1, pa.int64()),
                         *(pa.nulls(1, c.type) for c in rows[part.num_columns + 1:-4]),
                         *_block(x, many_b)], names)
                number += 1

    place = f"{shared_folder(docs.sparkSession).rstrip('/')}/alignment-{uuid.uuid4().hex}"
    df.mapInArrow(run, ", ".join([*fields, "block long", "place long", COUNTED, BLOCK])) \
        .write.option("compression", "zstd").parquet(place)
    table = docs.sparkSession.read.parquet(place)
    blocks = table.where("place IS NULL")
    pairs = blocks.select("block", F.posexplode(F.arrays_zip("pairs", "pair_docs"))).select(
        "block", F.col("pos").alias("number"), "col.pairs", "col.pair_docs")
    counts = pairs.groupBy("pairs").agg(F.sum("pair_docs").alias("count"))
    of_a = Window.partitionBy(F.floor(F.col("pairs") / many_b))
    counts = counts.withColumn("best", F.col("count") == F.max("count").over(of_a))
    answers = pairs.join(counts, "pairs").select(
        F.col("block").alias("to_block"), "number", "count", "best")
    sums = blocks.select("block", "sizes", "packed").groupBy("block").cogroup(
        answers.groupBy("to_block")).applyInArrow(_summed, "block long, place long, n_best long, "
                                               "count_sum long")
    rows = table.where("place IS NOT NULL").drop(*[c.split()[0] for c in BLOCK.split(", ")])
    joined = rows.join(sums, ["block", "place"], "left")
    return joined.select(*[F.col(f"k_{c}").alias(c) for c in keep], *out[:5], *(
        F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in out[5:]))


def _block(x: Aligned, many_b: int) -> list[pa.Array]:
    """The distinct pairs of a block, the most frequent first, and its links as their numbers."""
    pairs, at, total = np.unique(x.a[x.link_a] * many_b + x.b[x.link_b], return_inverse=True,
                                 return_counts=True)
    rank = np.empty(len(pairs), np.int64)
    order = np.argsort(-total, kind="stable")
    rank[order] = np.arange(len(pairs))
    numbers, sizes = rank[at], np.diff(x.link_starts)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    held = np.unique(doc * len(pairs) + numbers) % len(pairs)
    docs = np.bincount(held, minlength=len(pairs))
    return [pa.array([pairs[order]], pa.list_(pa.int64())), pa.array([docs], pa.list_(pa.int32())),
            pa.array([sizes], pa.list_(pa.int32())), pa.array([pack(numbers)], pa.binary())]


def _summed(block: pa.Table, answers: pa.Table) -> pa.Table:
    number = answers.column("number").to_numpy()
    count, best = np.zeros(len(number), np.int64), np.zeros(len(number), np.int64)
    count[number] = answers.column("count").to_numpy()
    best[number] = answers.column("best").to_numpy()
    sizes = block.column("sizes")[0].values.to_numpy().astype(np.int64)
    links = unpack(block.column("packed")[0].as_py(), int(sizes.sum()))
    ends = np.cumsum(sizes)
    sums = [np.concatenate([[0], np.cumsum(v[links])]) for v in (best, count)]
    return pa.table([pa.array(np.full(len(sizes), block.column("block")[0].as_py())),
                     pa.array(np.arange(len(sizes))),
                     *(pa.array(s[ends] - s[ends - sizes]) for s in sums)],
                    names=["block", "place", "n_best", "count_sum"])


def op13_lockstep_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of operator 13: counts of tokens, groups and links of every document."""
    return align_and_count(read(spark, sf_dir, "documents"), keep=["doc_id"])
