"""Test-set passages against a plain search for every window."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from vouch.llm import decontamination as dc


def plain_words(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def plain_windows(tests, size):
    windows = defaultdict(set)
    for item, text in tests:
        w = plain_words(text)
        for k in range(max(min(len(w), 1), len(w) - size + 1)):
            windows[tuple(w[k:k + size])].add(item)
    return windows


def plain_found(text, windows):
    """(number of words, numbers of hit words, items) of a text."""
    w = plain_words(text)
    hit, items = set(), set()
    for n in {len(x) for x in windows}:
        for k in range(len(w) - n + 1):
            got = windows.get(tuple(w[k:k + n]))
            if got is not None:
                hit.update(range(k, k + n))
                items |= got
    return len(w), hit, sorted(str(i) for i in items if i is not None)


def covered(spans):
    for a, b in zip(spans, spans[1:], strict=False):
        assert a["start"] + a["length"] < b["start"]
    return {i for s in spans for i in range(s["start"], s["start"] + s["length"])}


TESTS = [
    (1, "The quick, brown fox jumps over the lazy dog; again and again it jumps!"),
    (2, "quick brown fox jumps over the lazy dog again and"),  # one window, also in 1
    (3, "Zwölf Boxkämpfer"), (4, "É"), (5, None), (6, " .,- "), (7, "short ONE here"),
    (7, "short ONE here"), (None, "an item without any name is found but never counted at all"),
    (9, "a b a b a b a b a b a b a b a b"), (10, "x" * 40 + "tailtail y z"),
]
DOCS = [
    (1, "Say: the QUICK brown fox\njumps over the lazy-dog again and again it stops."),
    (2, "quick brown fox jumps over the lazy dog again"), (3, None), (4, ""), (5, "!?"),
    (6, "zwölf boxkämpfer zwölf x zwölf boxkämpfer"), (7, "é É é"), (8, "Short; one.here short one"),
    (9, "so an item without any name is found but never counted at all"),
    (10, "b a b a b a b a b a b a b a b"), (11, "w" * 40 + "tailtail y z"), (11, "a b"), (11, "a b"),
    (None, "short one here" + " and more words" * 5000 + " short one here"),
]


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_operator(spark, block_bytes):
    docs = spark.createDataFrame([(d, t, 1) for d, t in DOCS], "doc_id long, text string, items int")
    tests = spark.createDataFrame(TESTS, "item_id long, text string")
    rows = dc.find_passages(docs, tests, block_bytes=block_bytes).collect()
    windows = plain_windows(TESTS, 10)
    got = sorted((str(r.doc_id), r.n_words, sorted(covered(r.hits)), r["items"]) for r in rows)
    want = sorted((str(d), n, sorted(hit), items)
                  for d, t in DOCS for n, hit, items in [plain_found(t, windows)])
    assert got == want
    none = tests.where("false")
    assert {len(r.hits) for r in dc.find_passages(docs, none, block_bytes=block_bytes).collect()} == {0}
    assert dc.find_passages(docs.where("false"), tests, block_bytes=block_bytes).collect() == []


@pytest.mark.parametrize("seed", range(4))
def test_few_words_many_collisions(seed):
    rng = random.Random(seed)
    small = ["a", "b", "ab", "ba"]
    tests = [(k, " ".join(rng.choices(small, k=rng.randrange(1, 30)))) for k in range(40)]
    texts = [" ".join(rng.choices(small, k=rng.randrange(0, 600))) for _ in range(20)]
    texts += [t + " " + tests[3][1] + " " + t for t in texts[:5]]
    found = dc.machines([str(k) for k, _ in tests], [t for _, t in tests])
    counts, spans, items = dc._search(pa.array(texts), found)
    windows = plain_windows(tests, 10)
    for text, n, s, i in zip(texts, counts.to_pylist(), spans.to_pylist(), items.to_pylist(),
                             strict=True):
        assert (n, covered(s), i) == plain_found(text, windows)


def test_most_positions_are_skipped():
    rng = np.random.default_rng(1)
    draw = [f"w{k}" for k in range(5000)]
    texts = [" ".join(rng.choice(draw, 3000)) for _ in range(4)]
    (table,), _ = dc.machines(["1"], [" ".join(rng.choice(draw, 40))])
    seen = 0

    class Watched(dc.Words):
        def block(self, at, width):
            nonlocal seen
            seen += len(at)
            return super().block(at, width)

    table.candidates(Watched(pa.array(texts)))
    assert seen < 12_000 / 7


def test_long_items_are_cut_into_pieces_that_share_windows(spark, monkeypatch):
    monkeypatch.setattr(dc, "PIECE_WORDS", 15)
    text = " ".join(f"w{k}" for k in range(53))
    batch = pa.RecordBatch.from_arrays([pa.array(["1"]), pa.array([text])], ["item", "text"])
    (out,) = dc._pieces(iter([batch]), 10)
    pieces = [(1, t) for t in out.column(1).to_pylist()]
    assert len(pieces) == 3
    assert set(plain_windows(pieces, 10)) == set(plain_windows([(1, text)], 10))


def test_registered_query(spark, sf):
    rows = {r.doc_id: r for r in dc.op12_wu_manber(spark, sf).collect()}
    tests = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select(
        "item_id", "text").collect()]
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    windows = plain_windows(tests, 10)
    assert len(rows) == len(docs) and any(r.contaminated for r in rows.values())
    for doc_id, text in docs:
        n, hit, items = plain_found(text, windows)
        r = rows[doc_id]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, len(hit), len(items), bool(hit))
        assert r.items_sha256 == hashlib.sha256(",".join(items).encode()).hexdigest()
