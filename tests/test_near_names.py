"""The similarity join of names against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from vouch.functions.similarity import token_set_ratio
from vouch.operators import near_names

WORDS = ["saffron", "garden", "of", "king", "pars", "caspian", "blue", "old", "a", "b", "no", "9",
         "رستوران", "تهران", "خانه", "shop", "bazaar", "mina"]


def typo(rng, name):
    letters = list(name)
    for _ in range(rng.randrange(4)):
        i = rng.randrange(len(letters) + 1)
        if rng.random() < 0.5 and len(letters) > 1 and i < len(letters):
            del letters[i]
        else:
            letters.insert(i, rng.choice("aeiourst "))
    return " ".join("".join(letters).split())


def names(seed, n):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        kind = rng.random()
        if kind < 0.5 or not out:
            out.append(" ".join(rng.choices(WORDS, k=rng.randrange(1, 6))))
        elif kind < 0.9:
            out.append(typo(rng, rng.choice(out)))
        else:  # one-letter words: no gram is certain
            out.append(" ".join(rng.choices("abcdefg", k=rng.randrange(1, 5))))
    return out


@pytest.mark.parametrize(("seed", "least"), [(1, 80.0), (2, 80.0), (3, 60.0), (4, 92.0)])
def test_no_similar_pair_is_missed(spark, seed, least):
    left = spark.createDataFrame([(n,) for n in names(seed, 150)], "name string")
    right = spark.createDataFrame([(n,) for n in names(seed, 70) + names(seed + 50, 80)],
                                  "r_name string")
    both = left.distinct().crossJoin(right.distinct()).where("name <> '' AND r_name <> ''")
    want = {(r.name, r.r_name): round(r.s, 6) for r in both.withColumn(
        "s", token_set_ratio("name", "r_name")).where(F.col("s") >= least).collect()}
    got = {(r.name, r.r_name): round(r.similarity, 6)
           for r in near_names.similar_names(left, right, [], least).collect()}
    assert len(want) > 100 and got == want


def test_candidates_are_few(spark):
    """Very many names at one spot: what is compared letter by letter grows with what is similar."""
    rng = random.Random(7)
    made = ["".join(rng.choices("bcdfghklmnprst", k=3)) + rng.choice("aeiou")
            + "".join(rng.choices("bcdfghklmnprstaeiou", k=rng.randrange(2, 7))) for _ in range(6000)]
    rows = sorted({" ".join(rng.choices(made, k=rng.randrange(1, 4))) for _ in range(2400)})
    df = spark.createDataFrame([(r,) for r in rows], "name string")
    found = near_names.candidate_names(df, df.withColumnRenamed("name", "r_name"), []).count()
    assert len(rows) <= found < 0.01 * len(rows) ** 2


def test_places_of_similar_names(spark):
    rng = random.Random(9)
    pool = names(9, 60)
    spots = [(rng.choice("xy"), rng.choice(pool), 43.7 + rng.uniform(0, 0.004),
              -79.4 + rng.uniform(0, 0.004)) for _ in range(160)]
    left = spark.createDataFrame(spots[:80], "k string, name string, lat double, lng double")
    right = spark.createDataFrame(spots[80:], "k string, r_name string, r_lat double, r_lng double")
    got = {tuple(r) for r in near_names.similar_within(left, right, ["k"], 150.0).select(
        "k", "name", "lat", "lng", "r_name", "r_lat", "r_lng").collect()}
    from tests.test_matching import meters
    from vouch.operators.spatial import pairs_within  # noqa: F401

    sims = {(r.name, r.r_name) for r in near_names.similar_names(left, right, []).collect()}
    want = {(k, n, a, b, m, c, d) for k, n, a, b in spots[:80] for j, m, c, d in spots[80:]
            if k == j and n != m and (n, m) in sims and meters((a, b), (c, d)) <= 150.0}
    assert got == want and len(want) > 10
