"""Periodic runs of words: string synchronising sets at dyadic scales."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vouch.llm.common import read, text_slices

#: Fewest words of a run.
LEAST = 12
#: Periods below three times the first scale are found by comparing words at that distance.
FIRST_SCALE = 8
#: Text bytes of one step; about 25 times as much memory is in use.
STEP_BYTES = 2 << 20
PRIME = np.uint64((1 << 31) - 1)
BASES = (np.uint64(1_000_003_721 % ((1 << 31) - 1)), np.uint64(1_402_024_253 % ((1 << 31) - 1)))
LAST = np.uint64(0xFFFFFFFFFFFFFFFF)

Runs = tuple[np.ndarray, np.ndarray, np.ndarray]


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit mix of each number."""
    x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15 * (seed + 1) & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def doubled(h: np.ndarray, by: int) -> np.ndarray:
    """Hashes of stretches twice as long, from those of length ``by`` (shorter at the end)."""
    return mixed(h[:-by] * np.uint64(0xD6E8FEB86659FD93) ^ h[by:]) if len(h) > by else h[:0]


class Extensions:
    """Lengths of equal stretches by prefix hashes modulo a prime, for two independent bases."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        self.n, self.sums, self.powers = n, [], []
        for k, base in enumerate(BASES):
            power = np.ones(n + 1, np.uint64)
            filled, step = 1, base
            while filled <= n:
                more = min(filled, n + 1 - filled)
                power[filled:filled + more] = power[:more] * step % PRIME
                step = step * step % PRIME
                filled += more
            value = (mixed(words, 7 + k) >> np.uint64(33)) * power[:n] % PRIME
            total = np.zeros(n + 1, np.uint64)
            np.cumsum(value, out=total[1:])
            self.sums.append(total % PRIME)
            self.powers.append(power)

    def equal(self, x: np.ndarray, y: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the stretches at x < y are equal."""
        out = np.ones(len(x), bool)
        for total, power in zip(self.sums, self.powers, strict=True):
            left = (total[x + length] + PRIME - total[x]) % PRIME * power[y - x] % PRIME
            out &= left == (total[y + length] + PRIME - total[y]) % PRIME
        return out

    def right(self, x: np.ndarray, y: np.ndarray, most: int) -> np.ndarray:
        """Equal words from x and y > x on, at most ``most``."""
        done = np.zeros(len(x), np.int64)
        for bit in range(max(most, 1).bit_length() - 1, -1, -1):
            more = done + (1 << bit)
            fits = y + more <= self.n
            fits[fits] = self.equal(x[fits], y[fits], more[fits])
            done = np.where(fits, more, done)
        return done

    def left(self, x: np.ndarray, y: np.ndarray, most: int) -> np.ndarray:
        """Equal words before x and y > x, at most ``most``."""
        done = np.zeros(len(x), np.int64)
        for bit in range(max(most, 1).bit_length() - 1, -1, -1):
            more = done + (1 << bit)
            fits = more <= x
            fits[fits] = self.equal(x[fits] - more[fits], y[fits] - more[fits], more[fits])
            done = np.where(fits, more, done)
        return done


def smallest_periods(runs: list[Runs]) -> Runs:
    """One run for each stretch, with its smallest period (the others are its multiples)."""
    left, right, period = (np.concatenate([r[k] for r in runs]) for k in range(3))
    order = np.lexsort((period, right, left))
    left, right, period = left[order], right[order], period[order]
    first = np.ones(len(left), bool)
    first[1:] = (left[1:] != left[:-1]) | (right[1:] != right[:-1])
    return left[first], right[first], period[first]


def short_periods(words: np.ndarray, below: int) -> list[Runs]:
    """Stretches of at least twice their period and eight words, for each period below a bound."""
    out = []
    for q in range(1, min(below, len(words))):
        same = words[:-q] == words[q:]
        edges = np.flatnonzero(np.diff(same, prepend=False, append=False))
        start, stop = edges[::2], edges[1::2]
        long = stop - start >= max(FIRST_SCALE - q, q)
        start, stop = start[long], stop[long]
        out.append((start, stop + q, np.full(len(start), q, np.int64)))
    return out


def synchronising(h: np.ndarray, scale: int, periodic: np.ndarray | None) -> np.ndarray:
    """Positions whose stretch, or that ``scale`` words on, has the least hash of the window of
    ``scale`` + 1 stretches; stretches of period up to a third of the scale take no part.

    Whether a position is chosen depends on the 2 * scale words from it alone, and every ``scale``
    neighbouring positions have a chosen one unless the 3 * scale - 1 words from the first have a
    period up to scale / 3.
    """
    if len(h) <= scale:
        return np.empty(0, np.int64)
    if periodic is not None:
        h = np.where(periodic, LAST, h)
    least, width = h, 1
    while width < scale:
        least, width = np.minimum(least[:-width], least[width:]), 2 * width
    least = np.minimum(least[:-1], least[1:])
    n = len(least)
    return np.flatnonzero(((least == h[:n]) | (least == h[scale:scale + n])) & (least != LAST))


def equal_context_pairs(context: np.ndarray, place: np.ndarray, low: int, high: int,
                        ) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places of one context whose distance is in [low, high)."""
    order = np.argsort(context, kind="stable")
    context, place = context[order], place[order]
    alive, lag, found = np.arange(len(place)), 1, []
    while len(alive):
        alive = alive[alive + lag < len(place)]
        distance = place[alive + lag] - place[alive]
        near = (context[alive + lag] == context[alive]) & (distance < high)
        alive, distance = alive[near], distance[near]
        far = distance >= low
        found.append((place[alive[far]], place[alive[far] + lag]))
        lag += 1
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def neighbouring_regions(runs: Runs, same: Extensions, low: int, high: int,
                         ) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places for periods in [low, high) whose stretches are two touching regions of one
    small period: there no position is chosen, so the regions themselves propose the distance."""
    left, right, period = runs
    use = (3 * period * 3 <= low) & (right - left >= low)
    left, right, period = left[use], right[use], period[use]
    order = np.lexsort((left, period))
    left, right, period = left[order], right[order], period[order]
    touch = np.flatnonzero((period[1:] == period[:-1]) & (left[1:] <= right[:-1]))
    xs, ys = [], []
    for k in touch.tolist():
        p, s1, s2 = int(period[k]), int(left[k]), int(left[k + 1])
        shift = np.arange(p)
        turned = shift[same.equal(s1 + shift, np.full(p, s2), np.full(p, p))]
        if not len(turned):
            continue
        most = min(high - 1, int(min(right[k] - s1, right[k + 1] - s2)))
        first = low + (s2 - s1 - int(turned[0]) - low) % p
        q = np.arange(first, most + 1, p)
        x = np.maximum(s1, s2 - q)
        xs.append(x)
        ys.append(x + q)
    if not xs:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(xs), np.concatenate(ys)


def all_runs(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray, least: int = LEAST) -> Runs:
    """Start, end and smallest period of every run of at least ``least`` words and twice its period.

    ``words`` has the words of many documents as numbers, each document followed by a number that
    occurs nowhere else; ``starts`` and ``sizes`` say where the documents are. Periods below 24
    come from comparing words at that distance. At scale t = 8, 16, ... periods in [3t, 6t) come
    from pairs of synchronising positions at that distance with the same 2t words, and from pairs
    of touching regions of small period, where there are no such positions; regions of small
    period are runs of the earlier scales. Each pair is extended both ways by hashes and kept if
    the stretch has twice the period.
    """
    if least < FIRST_SCALE:
        raise ValueError(f"runs of fewer than {FIRST_SCALE} words are not searched")
    runs = [(np.empty(0, np.int64),) * 3, *short_periods(words, 3 * FIRST_SCALE)]
    scale, longest = FIRST_SCALE, int(sizes.max(initial=0))
    if longest >= 6 * scale:
        same = Extensions(words)
        h = mixed(words)
        for by in (1, 2, 4):
            h = doubled(h, by)
        kept = np.arange(len(h))  # places of h in words
        while longest >= 6 * scale:
            known = smallest_periods(runs)
            runs = [known]
            # documents too short for a period of this scale go
            open_ = sizes >= 6 * scale
            edges = np.zeros(len(words) + 1, np.int64)
            edges[starts[open_]] = 1
            edges[(starts + sizes + 1)[open_]] -= 1
            inside = np.cumsum(edges)[kept] > 0
            h, kept = h[inside], kept[inside]
            small = (3 * known[2] <= scale) & (known[1] - known[0] >= scale)
            periodic = None
            if small.any():
                marks = np.zeros(len(words) + 1, np.int64)
                np.add.at(marks, known[0][small], 1)
                np.add.at(marks, known[1][small] - scale + 1, -1)
                periodic = np.cumsum(marks)[kept] > 0
            chosen = synchronising(h, scale, periodic)
            h2 = doubled(h, scale)
            chosen = chosen[chosen < len(h2)]
            x, y = equal_context_pairs(h2[chosen], kept[chosen], 3 * scale, 6 * scale)
            more = neighbouring_regions(known, same, 3 * scale, 6 * scale)
            x, y = np.concatenate([x, more[0]]), np.concatenate([y, more[1]])
            if len(x):
                q = y - x
                a, b = x - same.left(x, y, longest), y + same.right(x, y, longest)
                full = b - a >= 2 * q
                runs.append((a[full], b[full], q[full]))
            h, kept = h2, kept[:len(h2)]
            scale *= 2
    left, right, period = smallest_periods(runs)
    long = right - left >= np.maximum(least, 2 * period)
    left, right, period = left[long], right[long], period[long]
    order = np.lexsort((period, left))
    return left[order], right[order], period[order]


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def find_runs(docs: DataFrame, text: str = "text", keep: list[str] | None = None,
              least: int = LEAST) -> DataFrame:
    """Columns ``keep`` (default: all), ``n_words``, ``runs`` and ``collapsed``.

    ``runs``: array of (start, length, period), by start, then period: every maximal stretch of
    words with that smallest period, of at least ``least`` words and twice the period. Words are
    compared as they are. ``collapsed``: the words that no run repeats (those after a run's first
    period go), joined by one space.

    One narrow pass: a row's result depends on its text alone, so rows of equal texts have equal
    results, and lost tasks are repeated alone. A null, empty or blank text has no words, an empty
    array and an empty ``collapsed``. The memory of a task is that of ``STEP_BYTES`` of text, or of
    its longest text. Columns of the input named like an output must not be in ``keep``.
    """
    out = ("n_words", "runs", "collapsed")
    keep = [c for c in docs.columns if c not in out] if keep is None else keep
    df = docs.select(*[docs[c] for c in keep], docs[text].alias("_text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema[:-1]),
                        "n_words long", "runs array<struct<start: long, length: long, "
                        "period: long>>", "collapsed string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch, "_text", STEP_BYTES):
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], *_found(texts, least)], [*part.schema.names[:-1], *out])

    return df.mapInArrow(run, schema)


def _found(texts: pa.Array, least: int) -> tuple[pa.Array, pa.Array, pa.Array]:
    split = pc.ascii_split_whitespace(texts)
    flat = split.flatten()
    # blanks at the ends of a text give empty words
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    before = np.concatenate([[0], np.cumsum(full)])
    bounds = np.concatenate([[0], np.cumsum(
        pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64))])
    sizes = np.diff(before[bounds])
    flat = flat.filter(pa.array(full))
    codes = pc.dictionary_encode(flat)
    n = len(sizes)
    ends = np.cumsum(sizes)
    starts = ends - sizes + np.arange(n)
    words = np.empty(len(flat) + n, np.int64)
    ordinary = np.ones(len(words), bool)
    ordinary[ends + np.arange(n)] = False
    words[ordinary] = codes.indices.to_numpy(zero_copy_only=False)
    words[~ordinary] = len(codes.dictionary) + np.arange(n)
    left, right, period = all_runs(words, starts, sizes, least)
    doc = np.searchsorted(starts, left, "right") - 1
    offsets = np.searchsorted(doc, np.arange(n + 1))
    listed = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(
        [pa.array(left - starts[doc]), pa.array(right - left), pa.array(period)], fields=list(RUN)))
    if len(left):
        marks = np.zeros(len(words) + 1, np.int64)
        np.add.at(marks, left + period, 1)
        np.add.at(marks, right, -1)
        stays = (np.cumsum(marks)[:-1] == 0)[ordinary]
        flat = flat.filter(pa.array(stays))
        ends = np.concatenate([[0], np.cumsum(stays)])[ends]
    collapsed = pc.binary_join(pa.LargeListArray.from_arrays(
        pa.array(np.concatenate([[0], ends]), pa.int64()), flat), " ")
    return pa.array(sizes, pa.int64()), listed, collapsed.cast(pa.string())


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, t) of the registered query: the text of one document in ten, by its doc_id, becomes
    periodic from some word on (a null doc_id: none)."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("w"),
                       F.floor(h / 10).alias("g"), F.size("w").alias("n"))
    a = (F.col("g") % F.col("n")).cast("int")
    p = (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int")
    rows = rows.withColumn("a", F.when(F.col("n") > 0, a)).withColumn("p", p)
    left = F.col("n") - F.col("a")
    copies = F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")),
                                      F.ceil(left / F.col("p")).cast("int")))
    turned = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")),
                                   F.slice(copies, F.lit(1), left)), " ")
    return rows.select("doc_id", F.when(F.col("n") > 0, turned).otherwise(F.col("text")).alias("t"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of operator 11: runs and collapsed text of every document, as digests."""
    docs = planted(read(spark, sf_dir, "documents").select("doc_id", "text"))
    found = find_runs(docs, "t", keep=["doc_id"])
    lines = F.array_join(F.transform("runs", lambda r: F.concat(
        r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","),
        r["period"].cast("string"), F.lit("\n"))), "")
    best = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    best = found.withColumn("_best", best)
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("_best.start")).alias("start"),
        F.col("_best.length").alias("length"), (-F.col("_best.period")).alias("period"),
        F.floor(F.col("_best.length") * 1000 / -F.col("_best.period")).cast("long")
        .alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
