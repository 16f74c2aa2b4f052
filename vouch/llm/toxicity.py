"""Toxicity scores from a convolutional text classifier over hashed word embeddings, in numpy."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vouch.llm.common import in_fold, read, text_bytes, text_slices, words_of
from vouch.operators.lineage import cut

#: Rows of the embedding table (a power of two), numbers in a row, filter widths, filters of each.
TABLE, DIM, WIDTHS, FILTERS = 1 << 16, 8, (1, 2, 3), 16
#: Labelled rows of a block, about. Each block is learned by one call; what they learn is averaged.
BLOCK_ROWS = 16384
#: One in so many labelled rows is kept back to calibrate the thresholds.
KEPT_BACK = 5
#: Rounds of averaging, and passes over a block in each.
ROUNDS, PASSES = 3, 2
BATCH, RATE, DECAY, SEED = 32, 0.05, 1e-5, 42
#: Numbers of a model that are averaged by one call; steps of a score in the calibration.
CHUNK, LEVELS = 1 << 15, 10_000
#: Held-out rows of the registered query: crc32(doc_id as text) mod 5 = 0.
FOLDS, HELD_OUT = 5, 0
#: Letters at the front of a word that make its second key, so that endings can vary.
STEM = 4
MARKS = ".,;:!?\"'()[]{}<>*_-"
#: Text bytes scored in one step; the activations take about 70 times as much.
STEP_BYTES = 1 << 20
#: Type of a word's two table rows where they are kept: two thirds of a text's own size.
KEY = np.min_scalar_type(TABLE - 1)


def word_keys(words: pa.Array) -> np.ndarray:
    """Two rows of the embedding table for each word: of the word without marks around it, and
    of its first letters."""
    coded = words.dictionary_encode()
    known = []
    hashed = xxhash.xxh64_intdigest
    for w in coded.dictionary.to_pylist():
        w = w.strip(MARKS)
        known.append((hashed(w, 1) & TABLE - 1, hashed(w[:STEM], 2) & TABLE - 1))
    table = np.array(known, np.int32).reshape(-1, 2)
    return table[coded.indices.to_numpy(zero_copy_only=False)]


@dataclass
class Model:
    """Embedding, filters (width, DIM, FILTERS for each width), their biases, output weights and
    bias; thresholds by language (None: any other)."""

    table: np.ndarray
    filters: list[np.ndarray]
    biases: list[np.ndarray]
    out: np.ndarray
    bias: float
    thresholds: dict[str | None, float] = field(default_factory=dict)

    def numbers(self) -> np.ndarray:
        """All weights in one array."""
        parts = [self.table, *self.filters, *self.biases, self.out, np.array([self.bias])]
        return np.concatenate([p.ravel() for p in parts]).astype(np.float32)

    @staticmethod
    def of(numbers: np.ndarray) -> Model:
        """The model of such an array; it shares no memory with it."""
        shapes = [(TABLE, DIM), *[(w, DIM, FILTERS) for w in WIDTHS], *[(FILTERS,) for _ in WIDTHS],
                  (FILTERS * len(WIDTHS),), (1,)]
        ends = np.cumsum([np.prod(x) for x in shapes])
        table, *rest, out, bias = [p.reshape(x).astype(np.float32) for p, x in zip(
            np.split(numbers, ends[:-1]), shapes, strict=True)]
        n = len(WIDTHS)
        return Model(table, rest[:n], rest[n:], out.astype(np.float64), float(bias[0]))

    def responses(self, keys: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
        """For each width the filter responses at every position; texts are spaced by rows of
        zeros, so that no filter sees two texts and short texts have positions too."""
        gap = max(WIDTHS)
        rows = np.arange(len(keys)) + np.repeat(np.arange(len(counts)) * gap, counts)
        x = np.zeros((len(keys) + gap * (len(counts) + 1), DIM), np.float32)
        x[rows] = self.table[keys[:, 0]] + self.table[keys[:, 1]]
        n = len(keys) + gap * len(counts)
        out = []
        for w, bias in zip(self.filters, self.biases, strict=True):
            y = x[:n] @ w[0]
            for k in range(1, len(w)):
                y += x[k:n + k] @ w[k]
            out.append(y + bias)
        return out

    def score(self, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Between 0 and 1 for each text."""
        if not len(counts):
            return np.empty(0)
        starts = np.cumsum(counts + max(WIDTHS)) - counts - max(WIDTHS)
        # up to one row behind a text: from further on, filters would see the next text
        edges = np.stack([starts, starts + counts + 1], axis=1).ravel()
        pooled = np.concatenate([np.maximum.reduceat(y, edges, axis=0)[::2]
                                 for y in self.responses(keys, counts)], axis=1)
        z = np.maximum(pooled, 0).astype(np.float64) @ self.out + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def constant(share: float) -> Model:
    """The model of a table that has one class only, or no labels."""
    share = min(max(share, 1e-6), 1 - 1e-6)
    return Model(np.zeros((TABLE, DIM), np.float32),
                 [np.zeros((w, DIM, FILTERS), np.float32) for w in WIDTHS],
                 [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
                 np.zeros(FILTERS * len(WIDTHS)), float(np.log(share / (1 - share))), {None: 0.5})


def untrained() -> Model:
    rng = np.random.default_rng(SEED)
    return Model(rng.normal(0, 0.1, (TABLE, DIM)).astype(np.float32),
                 [rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS],
                 [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
                 rng.normal(0, 0.3, FILTERS * len(WIDTHS)), 0.0)


def learn(m: Model, texts: list[np.ndarray], labels: np.ndarray, prior: float,
          rng: np.random.Generator) -> Model:
    """Change ``m`` by stochastic gradient steps with per-weight rates, ``PASSES`` times over the
    texts (word keys). ``prior``, the share of class 1 among all, weighs the rarer class up."""
    weight = np.where(labels == 1, 0.5 / prior, 0.5 / (1 - prior)) ** 0.5
    sums = [np.full_like(a, 1e-4, dtype=np.float64) for a in (m.table, m.out, *m.filters, *m.biases)]
    bias_sum, gap = 1e-4, max(WIDTHS)

    def step(a: np.ndarray, total: np.ndarray, grad: np.ndarray, rows=slice(None)) -> None:
        grad = grad + DECAY * a[rows]
        total[rows] += grad * grad
        a[rows] -= (RATE * grad / np.sqrt(total[rows])).astype(a.dtype)

    for _ in range(PASSES):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), BATCH):
            chosen = order[at:at + BATCH]
            counts = np.array([len(texts[i]) for i in chosen])
            keys = np.concatenate([texts[i] for i in chosen])
            starts = np.cumsum(counts + gap) - counts - gap
            ys = m.responses(keys, counts)
            where = [np.stack([s + y[s:s + n].argmax(0) for s, n in zip(starts, counts + 1,
                                                                        strict=True)]) for y in ys]
            top = [np.take_along_axis(y, w, 0) for y, w in zip(ys, where, strict=True)]
            act = np.maximum(np.concatenate(top, axis=1), 0).astype(np.float64)
            p = 1 / (1 + np.exp(-np.clip(act @ m.out + m.bias, -40, 40)))
            err = (p - labels[chosen]) * weight[chosen] / len(chosen)
            back = (err[:, None] * m.out[None, :]) * (act > 0)
            # where the rows of the texts stand among the rows with gaps; -1: a gap
            spaced = np.full(len(keys) + gap * (len(counts) + 1), -1)
            spaced[np.arange(len(keys)) + np.repeat(np.arange(len(counts)) * gap, counts)] = \
                np.arange(len(keys))
            rows_at, rows_grad = [], []
            grads = []
            for k, w in enumerate(m.filters):
                g = back[:, k * FILTERS:(k + 1) * FILTERS]
                gw = np.zeros(w.shape)
                for j in range(len(w)):
                    src = spaced[where[k] + j]
                    full = src >= 0
                    row = keys[src[full]]
                    f = np.broadcast_to(np.arange(FILTERS), src.shape)[full]
                    x = m.table[row[:, 0]] + m.table[row[:, 1]]
                    np.add.at(gw[j].T, f, g[full][:, None] * x)
                    gx = g[full][:, None] * w[j].T[f]
                    rows_at += [row[:, 0], row[:, 1]]
                    rows_grad += [gx, gx]
                grads.append((gw, g.sum(0)))
            step(m.out, sums[1], act.T @ err)
            bias_sum += float(err.sum()) ** 2
            m.bias -= RATE * float(err.sum()) / bias_sum ** 0.5
            for k, (gw, gb) in enumerate(grads):
                step(m.filters[k], sums[2 + k], gw)
                step(m.biases[k], sums[2 + len(WIDTHS) + k], gb)
            rows, inverse = np.unique(np.concatenate(rows_at), return_inverse=True)
            total = np.zeros((len(rows), DIM))
            np.add.at(total, inverse, np.concatenate(rows_grad))
            step(m.table, sums[0], total, rows)
    return m


def threshold(scores: np.ndarray, labels: np.ndarray, counts: np.ndarray | None = None) -> float:
    """The score that parts the classes with the fewest mistakes, in the middle of the gap there;
    0.5 where a class is absent. ``counts``: how many rows have the score and the label."""
    counts = np.ones(len(scores), np.int64) if counts is None else counts
    if not 0 < (labels * counts).sum() < counts.sum():
        return 0.5
    order = np.argsort(scores, kind="stable")
    s, y = scores[order], (labels * counts)[order]
    n = ((1 - labels) * counts)[order]
    # mistakes if the first k are taken as clean
    mistakes = np.concatenate([[0], np.cumsum(y)]) + n.sum() - np.concatenate([[0], np.cumsum(n)])
    best = np.flatnonzero(mistakes == mistakes.min())
    k = int(best[len(best) // 2])
    return float(((s[k - 1] if k else 0.0) + (s[k] if k < len(s) else 1.0)) / 2)


def keys_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    words, counts = words_of(texts)
    return word_keys(words), counts


def fit(docs: DataFrame, labels: DataFrame, leave_out: tuple[int, int] | None = (FOLDS, HELD_OUT),
        ) -> Model:
    """Learn from all labelled documents, whole texts, outside the fold ``leave_out``; one in
    ``KEPT_BACK`` of them calibrates a threshold for each language instead.

    The rows are dealt by a hash of doc_id to blocks of about ``BLOCK_ROWS``. In each of ``ROUNDS``
    rounds every block starts from the same model and learns alone; the mean of what the blocks
    have learned, weighed by their rows, starts the next round. The result depends on the rows only,
    not on partitions. The driver gets counts and one model (about 2 MB, of fixed size) a round.

    An id that repeats over rows is one of them, with the text of the smallest hash. Labels other
    than 0 and 1 and null ids are left out. Language only picks a threshold; it is no input of the
    score.
    """
    usable = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("_toxic")).distinct()
    if leave_out:
        usable = usable.where(~in_fold(F.col("doc_id"), *leave_out))
    back = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(KEPT_BACK)) == 0
    usable = usable.withColumn("_back", back)
    found = usable.join(docs.select(docs["doc_id"].cast("long").alias("doc_id")), "doc_id", "left_semi")
    there = found.groupBy("_toxic", "_back").count().collect()  # at most four rows
    ones, n = (sum(r["count"] for r in there if not r["_back"] and r["_toxic"] in of)
               for of in ((1,), (0, 1)))
    if not 0 < ones < n:
        some = sum(r["count"] for r in there)
        return constant(sum(r["count"] for r in there if r["_toxic"] == 1) / max(some, 1))
    prior, blocks = ones / n, -(-n // BLOCK_ROWS)
    lang = docs["lang"] if "lang" in docs.columns else F.lit(None)
    one = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.lit(None).cast("int").alias("_toxic"),
                      F.struct(F.xxhash64(docs["text"]).alias("h"), docs["text"].alias("text"),
                               lang.cast("string").alias("lang")).alias("_row")).where("doc_id IS NOT NULL")
    if leave_out:
        one = one.where(~in_fold(F.col("doc_id"), *leave_out))
    # texts and labels of an id meet in its block: the texts are shuffled once
    both = one.unionByName(usable.select("doc_id", "_toxic"), allowMissingColumns=True).withColumn(
        "_block", F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(blocks)))
    rows = both.repartition("_block").groupBy("_block", "doc_id").agg(
        F.min("_row").alias("_row"), F.collect_set("_toxic").alias("_marks"),
        F.count_if(F.col("_row").isNotNull()).alias("_texts")).where("_texts > 0").select(
        "_block", "doc_id", F.explode("_marks").alias("_toxic"), back.alias("_back"), "_row.text", "_row.lang")
    # fixed once, whole blocks in each partition: the rounds shuffle nothing and split no words
    rows = cut(_keyed(rows).sortWithinPartitions("_block", "doc_id", "_toxic"))
    model = untrained()
    for number in range(ROUNDS):
        model = _round(rows, model, prior, number, math.isqrt(blocks) + 1)
    _calibrate(rows, model)
    return model


def _keyed(rows: DataFrame) -> DataFrame:
    """``rows`` with the word keys instead of the text, so that a block of them stays small."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch, "text"):
                keys, counts = keys_of(texts)
                ends = np.concatenate([[0], np.cumsum(counts)]) * 2 * KEY.itemsize
                packed = pa.Array.from_buffers(pa.large_binary(), len(counts), [
                    None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(keys.astype(KEY))])
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], packed.cast(pa.binary())],
                                                 [*part.schema.names[:-1], "keys"])

    df = rows.select("_block", "doc_id", "_toxic", "_back", "lang", "text")
    return df.mapInArrow(run, "_block long, doc_id long, _toxic int, _back boolean, lang string, keys binary")


def _unpacked(packed: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word keys and each text's number of words, as of ``keys_of``."""
    data, starts = text_bytes(packed)
    return data.view(KEY).reshape(-1, 2), np.diff(starts) // (2 * KEY.itemsize)


def _round(rows: DataFrame, model: Model, prior: float, number: int, parts: int) -> Model:
    """The mean of what the blocks of ``rows`` learn from the model."""
    shared = rows.sparkSession.sparkContext.broadcast(model.numbers())

    def block(at: int, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        texts = [x for keys, counts, _ in parts for x in np.split(keys, np.cumsum(counts)[:-1])]
        y, n = np.concatenate([p[2] for p in parts]), len(texts)
        m = learn(Model.of(shared.value), texts, y, prior, np.random.default_rng([SEED, number, at]))
        out = m.numbers()
        for chunk, i in enumerate(range(0, len(out), CHUNK)):
            yield pa.RecordBatch.from_pydict({
                "chunk": [chunk], "part": [at], "n": [n],
                "numbers": [out[i:i + CHUNK].tobytes()]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for batch in batches:
            at = batch.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)]
            for start, stop in zip(edges, edges[1:], strict=False):
                if stop == start:  # an empty batch
                    continue
                if held and last != at[start]:
                    yield from block(last, held)
                    held = []
                part, last = batch.slice(start, stop - start), int(at[start])
                held.append((*_unpacked(part.column(2)), part.column(1).to_numpy().astype(np.int64)))
        if held:
            yield from block(last, held)

    def mean(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        total, n = 0.0, 0
        for k, numbers in zip(table.column("n").to_pylist(), table.column("numbers"), strict=True):
            total, n = total + k * np.frombuffer(numbers.as_buffer(), np.float32).astype(np.float64), n + k
        return pa.table([table.column("chunk")[:1], table.column("part")[:1], pa.array([n], pa.int64()),
                         pa.array([(total / n).astype(np.float32).tobytes()])], table.schema.names)

    shape = "chunk long, part long, n long, numbers binary"
    learned = rows.where("NOT _back").select("_block", "_toxic", "keys").mapInArrow(run, shape)
    # in two steps, so that no call gets a chunk of every block
    some = learned.groupBy("chunk", F.pmod("part", F.lit(parts)).alias("_p")).applyInArrow(
        lambda table: mean(table.select(["chunk", "part", "n", "numbers"])), shape)
    chunks = some.groupBy("chunk").applyInArrow(mean, shape).collect()
    shared.unpersist()
    return Model.of(np.concatenate([np.frombuffer(r["numbers"], np.float32)
                                    for r in sorted(chunks, key=lambda r: r["chunk"])]))


def _calibrate(rows: DataFrame, model: Model) -> None:
    """Set the thresholds by how many rows of each class have which score, in ``LEVELS`` steps."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, packed in text_slices(batch, "keys", STEP_BYTES // 2):
                level = np.rint(shared.value.score(*_unpacked(packed)) * LEVELS).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(level)],
                                                 ["lang", "_back", "_toxic", "level"])

    scored = rows.select(F.coalesce("lang", F.lit("")).alias("lang"), "_back", "_toxic", "keys").mapInArrow(
        run, "lang string, _back boolean, _toxic int, level int")
    counted = scored.groupBy("lang", "_back", "_toxic", "level").count().orderBy(
        "lang", "_back", "_toxic", "level").collect()
    langs = np.array([r["lang"] for r in counted])
    kept = np.array([r["_back"] for r in counted], bool)
    y = np.array([r["_toxic"] for r in counted], np.int64)
    s = np.array([r["level"] for r in counted]) / LEVELS
    n = np.array([r["count"] for r in counted], np.int64)
    # few rows of a language say little of its threshold: those learned from are used then as well
    for lang in sorted(set(langs.tolist())):
        own = (langs == lang) & kept
        if min((y * n)[own].sum(), ((1 - y) * n)[own].sum()) < 5:
            own = langs == lang
        model.thresholds[lang] = threshold(s[own], y[own], n[own])
    model.thresholds[None] = threshold(s[kept], y[kept], n[kept])


def score(docs: DataFrame, model: Model, text: str = "text", lang: str = "lang",
          keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (default: all), then score (0 to 1), predicted (1 from 0.5 on), threshold
    (of the row's language) and flagged (score from the threshold on).

    One narrow pass; the model (about 2 MB, of fixed size) goes out with the function. Null and
    empty texts get the score of a text without words. Columns of the input named like an output
    must not be in ``keep``.
    """
    names = ("score", "predicted", "threshold", "flagged")
    keep = [c for c in docs.columns if c not in names] if keep is None else keep
    tongue = docs[lang] if lang in docs.columns else F.lit(None).cast("string")
    df = docs.select(*[docs[c] for c in keep], tongue.alias("_lang"), docs[text].alias("_text"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema[:-2]]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part, texts in text_slices(batch, "_text", STEP_BYTES):
                s = m.score(*keys_of(texts))
                limits = np.array([m.thresholds.get(x or "", m.thresholds[None])
                                   for x in part.column(part.num_columns - 2).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-2], pa.array(s), pa.array((s >= 0.5).astype(np.int32)),
                     pa.array(limits), pa.array(s >= limits)], [*part.schema.names[:-2], *names])

    return df.mapInArrow(run, ", ".join(
        [*fields, "score double, predicted int, threshold double, flagged boolean"]))


def op6_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of operator 6: doc_id, held_out, score, predicted (and the language's threshold)."""
    docs = read(spark, sf_dir, "documents")
    model = fit(docs, read(spark, sf_dir, "labels"))
    return score(docs, model, keep=["doc_id"]).select(
        "doc_id", in_fold(F.col("doc_id"), FOLDS, HELD_OUT).alias("held_out"),
        "score", "predicted", "threshold", "flagged")
