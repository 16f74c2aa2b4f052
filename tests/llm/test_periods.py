"""Periodic runs against a search over all periods."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from vouch.llm import periods


def plain_runs(words, least=12):
    """Every stretch by trying each period; the first period found for a stretch is the smallest."""
    n, found, numbers = len(words), {}, {}
    w = np.array([numbers.setdefault(x, len(numbers)) for x in words], np.int64)
    for q in range(1, n // 2 + 1):
        same = w[:-q] == w[q:]
        edges = np.flatnonzero(np.diff(same, prepend=False, append=False)).tolist()
        for i, j in zip(edges[::2], edges[1::2], strict=True):
            if j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q), q)
    return sorted((a, b - a, q) for (a, b), q in found.items())


def plain_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_collapsed(words, runs):
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def plain_planted(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def sample(rng):
    kind = rng.randrange(6)
    if kind == 0:
        return [rng.randrange(2) for _ in range(rng.randrange(250))]
    if kind == 1:  # a word of many overlapping runs
        a, b = [0], [0, 1]
        while len(b) < 400:
            a, b = b, b + a
        return b[rng.randrange(9):rng.randrange(20, 400)]
    if kind == 2:  # regions of small period that touch
        u = [0, 1] * rng.randrange(1, 60) + [0] * rng.randrange(2)
        return (u * rng.randrange(2, 5) + [rng.randrange(3)]) * rng.randrange(1, 4)
    if kind == 3:
        u = [rng.randrange(40) for _ in range(rng.randrange(1, 150))]
        return [41, 42, *(u * rng.randrange(2, 5)), *u[:rng.randrange(len(u))], 43]
    p = [rng.randrange(3) for _ in range(rng.randrange(1, 9))]
    q = p * rng.randrange(10, 40)
    if kind == 4:
        return q + p[:1] + [5] + q
    return (q + [7]) * 3 + p * 20 + q


@pytest.mark.parametrize("seed", range(6))
def test_runs_of_many_documents_at_once(seed):
    rng = random.Random(seed)
    docs = [sample(rng) for _ in range(30)]
    sizes = np.array([len(d) for d in docs])
    starts = np.cumsum(sizes) - sizes + np.arange(len(docs))
    words = np.concatenate([np.array([*d, 1000 + k]) for k, d in enumerate(docs)])
    left, right, period = periods.all_runs(words, starts, sizes)
    want = [(a + int(s), n, q) for d, s in zip(docs, starts, strict=True) for a, n, q in plain_runs(d)]
    assert list(zip(left.tolist(), (right - left).tolist(), period.tolist(), strict=True)) == want


def test_synchronising_positions_are_dense_and_depend_on_their_context():
    rng = np.random.default_rng(3)
    words = rng.integers(0, 6, 4000)
    words[2000:2300] = words[100:400]
    h = periods.mixed(words)
    for by in (1, 2, 4):
        h = periods.doubled(h, by)
    chosen = periods.synchronising(h, 8, None)
    assert np.diff(chosen).max() <= 8 and len(chosen) < 0.4 * len(words)
    inside = chosen[(chosen >= 100) & (chosen < 400 - 16)] + 1900
    assert set(inside) == set(chosen[(chosen >= 2000) & (chosen < 2300 - 16)])


def test_pairs_and_regions_are_needed(monkeypatch):
    """Periods from 24 words on come from the scales alone."""
    rng = random.Random(8)
    u = [rng.randrange(1000) for _ in range(70)]
    v = ([0, 1] * 50 + [0]) * 2
    words = np.array([*u, *u, 2000, *v, 2001])
    size = np.array([len(words) - 1])
    want = set(plain_runs(words[:-1].tolist()))
    assert {q for _, _, q in want} >= {2, 70, 101}

    def found():
        a, b, q = periods.all_runs(words, np.array([0]), size)
        return set(zip(a.tolist(), (b - a).tolist(), q.tolist(), strict=True))

    none = (np.empty(0, np.int64), np.empty(0, np.int64))
    assert found() == want
    with monkeypatch.context() as m:
        m.setattr(periods, "neighbouring_regions", lambda *a: none)
        assert {q for _, _, q in want - found()} >= {101}
    monkeypatch.setattr(periods, "equal_context_pairs", lambda *a: none)
    assert {q for _, _, q in want - found()} >= {70}


ODD = [(1, None), (2, ""), (3, " \t\n "), (None, "a b " * 30), (5, "x " * 12), (5, "x " * 12),
       (6, "x " * 11), (7, "\ta b\n" * 6), (8, "É é  " * 20 + "  q"), (9, "A a " * 3),
       (10, "one"), (11, " ".join(f"w{i % 500}" for i in range(20_000)))]


def test_operator_on_odd_rows(spark):
    docs = spark.createDataFrame([(d, t, 1) for d, t in ODD], "doc_id long, text string, n_words int")
    rows = periods.find_runs(docs).orderBy("doc_id").collect()
    assert len(rows) == len(ODD)
    by_id = {(d, t): (w, plain_runs(w)) for d, t in ODD for w in [plain_words(t)]}
    got = sorted((str(r.doc_id), r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in rows)
    assert got == sorted((str(d), len(w), runs, plain_collapsed(w, runs))
                         for (d, t), (w, runs) in [((d, t), by_id[d, t]) for d, t in ODD])
    assert periods.find_runs(docs.where("false")).collect() == []


def test_registered_query(spark, sf):
    rows = {r.doc_id: r for r in periods.op11_periodic_runs(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(docs)
    for doc_id, text in docs:
        words = plain_planted(doc_id, plain_words(text))
        runs = plain_runs(words)
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
        lines = "".join(f"{a},{n},{q}\n" for a, n, q in runs)
        r = rows[doc_id]
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256(lines.encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(
            plain_collapsed(words, runs).encode()).hexdigest()
