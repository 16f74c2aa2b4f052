"""Near copies of the pipeline against all pairs of shingle sets."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vouch.llm import near_copies


def brute_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else {()}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def brute_classes(texts):
    """The place of the first text that each one is connected with, by all pairs."""
    sets = [brute_set(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if jaccard(a, sets[j]) >= 0.8:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [find(i) for i in range(len(texts))]


def changed(rng, words, share):
    return [f"{w}{rng.randint(0, 99)}x" if rng.random() < share else w for w in words]


def kept_ids(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    return sorted(r.doc_id for r in near_copies.one_of_each(df).collect())


def test_shingles_and_sequences():
    texts = ["", "one two", "ONE\ttwo", "a b c d e", "a b c d e f", "a b c d e f a b c d e", "two one"]
    hashes, numbers, sequence = near_copies.shingles_of(pa.array(texts))
    assert numbers.tolist() == [0, 1, 1, 1, 2, 7, 1]
    assert sequence[1] == sequence[2] and len(set(sequence.tolist())) == 6 and sequence[0] == 0
    parts = np.split(hashes, np.cumsum(numbers)[:-1])
    assert parts[1] == parts[2] and parts[3][0] == parts[4][0] == parts[5][0] == parts[5][6]
    alone = [near_copies.shingles_of(pa.array([t])) for t in texts]
    assert np.concatenate([a[0] for a in alone]).tolist() == hashes.tolist()
    both = near_copies.sketch(hashes, numbers)
    assert both.tolist() == [near_copies.sketch(a[0], a[1])[0].tolist() for a in alone]


def test_neighbours_are_all_within_the_radius(spark):
    rng = random.Random(5)
    values = {rng.getrandbits(32) for _ in range(60)} | {0, (1 << 32) - 1}
    for v in list(values)[:40]:
        for n in (1, 2, 3):
            values.add(v ^ sum(1 << k for k in rng.sample(range(32), n)))
    prints = [(k << 32) | v for v in sorted(values) for k in (0, 7)]
    got = {(a, b) for a, b in near_copies.neighbours(
        spark.createDataFrame([(p,) for p in prints], "grp long")).collect()}
    want = {(a, b) for a in prints for b in prints if a < b and a >> 32 == b >> 32
            and (a ^ b).bit_count() <= 2}
    assert got == want and len(want) >= 160


def test_fingerprints_of_one_class_form_no_pairs(spark, monkeypatch):
    """A large class would have pairs by the square of its size; those across classes all stay."""
    prints = [(1 << i | 1 << j, 5 if i < 8 else 0) for i in range(32) for j in range(i)]
    df = spark.createDataFrame(prints, "grp long, label long")
    got = {tuple(r) for r in near_copies.neighbours(df).collect()}
    want = {(a, b) for a, p in prints for b, q in prints if a < b and (a ^ b).bit_count() <= 2
            and not p == q == 5}
    assert got == want
    # and the classes are known before fingerprints are met with their neighbours
    rng = random.Random(3)
    words = [f"w{rng.randint(0, 900)}" for _ in range(300)]
    texts = [" ".join(w if k != i else "new" for k, w in enumerate(words)) for i in range(0, 300, 3)]
    seen, neighbours = [], near_copies.neighbours
    monkeypatch.setattr(near_copies, "neighbours", lambda p: seen.append(p) or neighbours(p))
    assert kept_ids(spark, texts) == [0]
    assert neighbours(seen[0]).count() < neighbours(seen[0].select("grp")).count() / 10


@pytest.mark.parametrize("seed", [1, 2])
def test_recall_of_pairs_at_the_bound_and_above(spark, seed):
    """Pairs that share a fingerprint's ball, of all pairs with similarity 0.8 to 0.9."""
    rng = random.Random(seed)
    texts, pairs = [], []
    while len(pairs) < 300:
        words = [f"w{rng.randint(0, 5000)}" for _ in range(rng.randint(60, 400))]
        other = changed(rng, words, rng.choice([0.01, 0.015, 0.02]))
        near = jaccard(brute_set(" ".join(words)), brute_set(" ".join(other)))
        if 0.8 <= near <= 0.9:
            pairs.append(near)
            texts += [" ".join(words), " ".join(other)]
    hashes, numbers, _ = near_copies.shingles_of(pa.array(texts))
    bits = near_copies.sketch(hashes, numbers).view(np.uint32).reshape(len(texts), -1)
    apart = np.bitwise_count(bits[::2] ^ bits[1::2])
    assert (apart.min(axis=1) <= near_copies.RADIUS).mean() >= 0.97
    assert apart.sum(axis=1).max() <= near_copies.MOST_APART


def test_kept_documents_equal_all_pairs(spark, monkeypatch):
    rng = random.Random(9)
    base = [[f"w{rng.randint(0, 900)}" for _ in range(rng.randint(80, 200))] for _ in range(30)]
    texts = [" ".join(w) for w in base]
    texts += [" ".join(changed(rng, w, s)) for w in base for s in (0.003, 0.01, 0.2)]
    texts += [t.upper() for t in texts[:5]] + ["", None, " \n", "one two", "one two three"]
    texts += ["long " * 40000, "long " * 40000 + "end", "tie " * 3, "tie " * 3]
    # a group of copies in a chain: each is near the last one, the ends are not near each other
    chain = base[0]
    for i in range(40):
        chain = chain[:i * 2] + [f"c{i}"] + chain[i * 2 + 1:]
        texts.append(" ".join(chain))
    want = sorted(set(brute_classes(texts)))
    assert kept_ids(spark, texts) == want
    # rounds alone, then all open pairs at once, give the same
    monkeypatch.setattr(near_copies, "FEW", 0)
    assert kept_ids(spark, texts) == want
    monkeypatch.setattr(near_copies, "FEW", 1e9)
    assert kept_ids(spark, texts) == want


def test_nulls_repeated_rows_and_empty_tables(spark):
    rows = [(None, "a b c d e f"), (5, "A b c d e f"), (5, "A b c d e f"), (None, None), (None, "x"),
            (9, None), (8, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit("own"))
    got = sorted(map(tuple, near_copies.one_of_each(df).collect()), key=repr)
    assert got == [(5, "A b c d e f", "own"), (8, "", "own"), (None, "x", "own")]
    assert near_copies.one_of_each(df.where("false")).count() == 0


def test_texts_with_much_of_their_own_are_not_compared_in_pairs(spark, monkeypatch):
    """A group just below the bound has pairs that meet by the square of its size."""
    rng = random.Random(4)
    words = [f"w{rng.randint(0, 900)}" for _ in range(95)]
    texts = []
    for i in range(200):
        at = rng.sample(range(5, 90), 3)
        texts.append(" ".join(f"own{i}x{k}" if k in at else w for k, w in enumerate(words)))
    # some have a near copy: a change of their own words, or a base without those words
    texts += [t.replace("own0x", "own1x", 1) for t in texts[:3]] + [" ".join(words), " ".join(words[1:])]
    compared, similar = [], near_copies._similar
    monkeypatch.setattr(near_copies, "FEW", 1)
    monkeypatch.setattr(near_copies, "_similar", lambda close, of: compared.append(close.count()) or similar(close, of))
    assert kept_ids(spark, texts) == sorted(set(brute_classes(texts)))
    assert sum(compared) < 1500


def test_sizes_admit_all_similar_sets(spark):
    rng = random.Random(8)
    sets = {}
    for i in range(60):
        base = range(100) if i % 2 else range(50, 130)
        sets[i] = {x for x in base if rng.random() > 0.04 * (i % 5)} | {1000 * i + k for k in range(i % 13)}
    rows = [(i, sorted(x)) for i, x in sets.items()]
    sizes = {r.node: r for r in near_copies._sizes(
        spark.createDataFrame(rows, "node long, shingles array<long>")).collect()}
    linked = [(a, b) for a in sets for b in sets if a < b and jaccard(sets[a], sets[b]) >= 0.8]
    assert len(linked) > 50 and all(sizes[i].n == len(sets[i]) for i in sets)
    assert all(sizes[a].n <= sizes[b].most and sizes[b].n <= sizes[a].most for a, b in linked)
    far = [i for i in sets if sizes[i].most < sizes[i].n]
    assert far and not [p for p in linked if p[0] in far and p[1] in far]
