"""SimHash near-duplicates against a brute-force version."""

import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from vouch.llm import simhash
from vouch.llm.components import components


def brute_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def brute_roots(values):
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, a in enumerate(values):
        for b in values[:i]:
            if bin(a ^ b).count("1") <= 4:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {v: find(v) for v in values}


TEXTS = ["", None, "  \n", "one", "One two three", "ONE\ttwo  three", "a b c d e f g",
         "é ß Ä ü \x1c x", "word " * 5000, "tie tie", "  nbsp is a word"]


def test_fingerprints_equal_brute_force():
    rng = random.Random(3)
    texts = TEXTS + [" ".join(rng.choice("abcdef") * rng.randint(1, 3) for _ in range(
        rng.randint(1, 80))) for _ in range(60)]
    found = simhash.fingerprint(pa.array([t or "" for t in texts]))
    assert found.tolist() == [brute_print(t) for t in texts]


def test_ball_holds_every_variant_once():
    masks = np.concatenate(list(simhash.BALL.values()))
    assert len(masks) == len(set(masks.tolist())) == 1 + 64 + 64 * 63 // 2
    assert len(simhash.BALL) == 1 + 16 + 16 * 15 // 2


def test_links_connect_what_brute_force_connects(spark):
    rng = random.Random(5)
    values = [rng.getrandbits(64) for _ in range(40)]
    for v in values[:20]:  # chains of changed bits, at and just over the radius
        for n in (1, 4, 5):
            v ^= sum(1 << k for k in rng.sample(range(64), n))
            values.append(v)
    values = sorted(set(values))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    pairs = [(a % (1 << 64), b % (1 << 64)) for a, b in simhash.links(df).collect()]
    assert all(bin(a ^ b).count("1") <= 4 for a, b in pairs)
    want = brute_roots(values)
    got = {v: v for v in values}
    grouped = {}
    for node, root in simhash.classes(df).collect():
        grouped.setdefault(root % (1 << 64), []).append(node % (1 << 64))
    for members in grouped.values():
        for m in members:
            got[m] = min(members)
    assert {v: min(w for w in values if want[w] == want[v]) for v in values} == got


def test_documents_with_copies_nulls_and_extra_columns(spark):
    rng = random.Random(7)
    base = [" ".join(rng.choice(["red", "green", "blue", "sky", "sea"]) + str(rng.randint(0, 9))
                     for _ in range(300)) for _ in range(6)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(20 + i, t.upper()) for i, t in enumerate(base)]  # same words
    rows += [(40 + i, t + " tail") for i, t in enumerate(base)]
    rows += [(60, None), (61, ""), (None, base[0]), (60, None), (62, "short")]
    df = spark.createDataFrame([(a, b, "x") for a, b in rows], "doc_id long, text string, fp string")
    got = sorted(map(tuple, simhash.near_duplicates(df).collect()), key=repr)
    prints = [brute_print(t) for _, t in rows]
    roots = brute_roots(sorted(set(prints)))
    least = {}
    for (d, _), p in zip(rows, prints):
        if d is not None:
            least[roots[p]] = min(d, least.get(roots[p], d))
    want = sorted(((d, f"{p:016x}", least.get(roots[p])) for (d, _), p in zip(rows, prints)),
                  key=repr)
    assert got == want
    kept = simhash.one_of_each(df.drop("fp")).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(least.values()))
    assert simhash.near_duplicates(df.where("false")).count() == 0


@pytest.mark.parametrize("order", ["up", "down", "mixed"])
def test_components_of_a_long_path(spark, order):
    edges = [(i, i + 1) for i in range(200)] + [(500, 501), (501, 500), (7, 7)]
    edges = {"up": edges, "down": [(b, a) for a, b in edges],
             "mixed": random.Random(1).sample(edges, len(edges))}[order]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.root for r in components(df).collect()}
    assert got == {**{i: 0 for i in range(201)}, 500: 500, 501: 500}
    assert components(df.where(F.lit(False))).count() == 0
