"""Resolution against one listing at a time, on small worlds full of chains and gaps."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from tests.test_matching import ENTITY, meters
from vouch.functions import text as tx
from vouch.functions.similarity import token_set_ratio, token_set_ratio_of
from vouch.operators.components import connected
from vouch.plans import resolve

LISTING = ("source_id string, external_id string, city_id long, name string, lat double, "
           "lng double, links array<struct<kind: string, value: string, url: string>>")


def one_at_a_time(rows, entities, holdings):
    """The rules as they are told, over plain lists; rows bring their normalised names."""
    known = {e["business_id"]: dict(e, links=set()) for e in entities}
    for business_id, kind, value in holdings:
        known[business_id]["links"].add((kind, value))
    out = {}
    for r in sorted(rows, key=lambda r: r["_ord"]):
        at = None if r["lat"] is None else (r["lat"], r["lng"])
        city = [(k, e) for k, e in sorted(known.items()) if e["city_id"] == r["city_id"]]

        def away(e, at=at):
            return None if at is None or e["lat"] is None else meters(at, (e["lat"], e["lng"]))

        links = {(x["kind"], x["value"]) for x in r["links"]}
        found = next(((k, "link") for k, e in city if links & e["links"]
                      and (away(e) is None or away(e) <= 1000)), None)
        if found is None and at is not None and r["key"]:
            alike = [(-s, n != r["key"], k) for k, e in city if away(e) is not None and away(e) <= 150
                     for n in (e["fa_key"], e["latin_key"]) if n
                     for s in [token_set_ratio_of(r["key"], n)] if s >= 80]
            found = (min(alike)[2], "name") if alike else None
        if found is None:
            k = hashlib.sha256(f"{r['source_id']}|{r['external_id']}".encode()).hexdigest()
            known[k] = {"city_id": r["city_id"], "lat": None, "lng": None, "fa_key": None,
                        "latin_key": None, "name_fa": None, "name_latin": None, "links": set()}
            found = (k, "new")
        e = known[found[0]]
        if e["lat"] is None:
            e["lat"], e["lng"] = r["lat"], r["lng"]
        for name, key in (("name_fa", "fa_key"), ("name_latin", "latin_key")):
            if e[name] is None and r[name] is not None:
                e[name], e[key] = r[name], r[key]
        e["links"] |= links
        out[r["source_id"], r["external_id"]] = found
    return out


def prepared(spark, listings, entities):
    fa, latin = tx.split_name("name")
    df = listings.select("*", resolve.order_key().alias("_ord"), fa.alias("name_fa"),
                         latin.alias("name_latin"), tx.normalize_name("name").alias("key"))
    rows = [r.asDict() for r in resolve._with_both_keys(df).collect()]
    held = [r.asDict() for r in resolve._with_both_keys(entities).collect()]
    return rows, held


NAMES = ["Shiraz House", "Shiraz Kitchen Hall", "Shirazz Houses", "تهران گریل", "Tehran Gril تهران گریل",
         "Tehran Grill", "Blue Door", "Blue Doors", "The Restaurant", "Saffron"]


def world(seed, n):
    rng = random.Random(seed)

    def spot():
        if rng.random() < 0.2:
            return None, None
        return 43.7 + rng.uniform(0, 0.02), -79.4 + rng.uniform(0, 0.006)

    rows = []
    for i in range(n):
        links = [("website", f"w{rng.randrange(n // 4)}", "u")] * (rng.random() < 0.4)
        links += [("phone", f"p{rng.randrange(n // 3)}", "u")] * (rng.random() < 0.3)
        rows.append((rng.choice(["osm", "overture", "wikidata"]), f"x{i:03d}", rng.randrange(1, 3),
                     rng.choice(NAMES), *spot(), links))
    held = [(f"{rng.choice('0f')}{k}", rng.randrange(1, 3), *spot(), rng.choice(NAMES[:6]), None)
            for k in range(n // 8)]
    links = [(h[0], "website", f"w{rng.randrange(n // 4)}") for h in held]
    return rows, held, links


@pytest.mark.parametrize(("seed", "city_rows"), [(0, 10_000), (2, 10_000), (1, 0)])
def test_equals_one_listing_at_a_time(spark, seed, city_rows):
    rows, held, links = world(seed, 130)
    listings = spark.createDataFrame(rows, LISTING)
    entities = spark.createDataFrame(held, ENTITY)
    holdings = spark.createDataFrame(links, "business_id string, kind string, value string")
    known = spark.createDataFrame([rows[0][:2] + (held[0][0],)],
                                  "source_id string, external_id string, business_id string")
    got = {(r.source_id, r.external_id): (r.business_id, r.stage) for r in resolve.resolve_entities(
        listings, entities, known, holdings, city_rows=city_rows).collect()}
    plain, base = prepared(spark, listings, entities)
    first = next(r for r in plain if (r["source_id"], r["external_id"]) == rows[0][:2])
    links += [(held[0][0], x["kind"], x["value"]) for x in first["links"]]
    want = one_at_a_time([r for r in plain if r is not first], base, links)
    assert got == want | {rows[0][:2]: (held[0][0], "record")}
    assert len({s for _, s in want.values()}) == 3


def test_a_listing_without_a_city_is_a_new_entity(spark):
    rows = [("osm", "a", None, "Blue Door", 43.7, -79.4, [("website", "w", "u")])] * 1
    rows += [("osm", "b", None, "Blue Door", 43.7, -79.4, [("website", "w", "u")])]
    none = [spark.createDataFrame([], s) for s in (
        ENTITY, "source_id string, external_id string, business_id string",
        "business_id string, kind string, value string")]
    got = resolve.resolve_entities(spark.createDataFrame(rows, LISTING), *none).collect()
    assert {r.stage for r in got} == {"new"} and len({r.business_id for r in got}) == 2


@pytest.mark.parametrize("order", ["mixed", "up"])
def test_a_long_line_takes_few_rounds(spark, order, monkeypatch):
    """A thousand listings of one name, 100 m apart."""
    n, rounds = 1000, []
    ranks = {"up": list(range(n)), "down": list(range(n))[::-1],
             "mixed": random.Random(2).sample(range(n), n)}[order]
    rows = [("osm", f"n{r:04d}", 1, "Tabriz Larder", 43.0 + i * 0.0009, -79.4, [])
            for i, r in enumerate(ranks)]
    monkeypatch.setattr(resolve, "connected", lambda m: rounds.append(1) or connected(m, 25))
    listings = spark.createDataFrame(rows, LISTING)
    none = spark.createDataFrame([], ENTITY)
    got = resolve.resolve_entities(
        listings, none, spark.createDataFrame([], "source_id string, external_id string, "
                                              "business_id string"),
        spark.createDataFrame([], "business_id string, kind string, value string"),
        city_rows=0).collect()
    found = {r.external_id: r for r in got}
    want, entities = set(), []
    for i, r in sorted(enumerate(ranks), key=lambda x: x[1]):
        if not any(abs(i - e) <= 1 for e in entities):
            entities.append(i)
            want.add(f"n{r:04d}")
    assert {k for k, r in found.items() if r.stage == "new"} == want and len(found) == n


def test_large_components_are_settled_in_rounds(spark):
    """One link over a crowd: beyond the walk's bound the rounds give the same leaders."""
    rng = random.Random(4)
    rows = [("osm", f"n{i:03d}", 1, "Restaurant", 43.70 + rng.uniform(0, 0.05),
             -79.40 + rng.uniform(0, 0.05), [("instagram", "chain", "u")]) for i in range(60)]
    listings = spark.createDataFrame(rows, LISTING)
    none = [spark.createDataFrame([], s) for s in (
        ENTITY, "source_id string, external_id string, business_id string",
        "business_id string, kind string, value string")]
    out = [{(r.external_id, r.stage == "new") for r in resolve.resolve_entities(
        listings, *none, city_rows=c, walk_rows=w).collect()} for c, w in ((5, 5), (5, 10_000))]
    assert out[0] == out[1] and len(out[0]) == 60


def test_components_of_a_line(spark):
    n = 1000
    members = [(f"n{k:04d}", f"g{g}") for k in range(n) for g in (k, k + 1)]
    roots = connected(spark.createDataFrame(members, "node string, grp string"), 25).collect()
    assert {r.root for r in roots} == {"n0000"} and len(roots) == n


def test_components_of_random_groups(spark):
    rng = random.Random(3)
    members = [(f"v{rng.randrange(400):03d}", f"g{rng.randrange(330)}") for _ in range(560)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for v, g in members:
        parent[find(g)] = find(v)
    least = {}
    for v, _ in members:
        least[find(v)] = min(least.get(find(v), v), v)
    got = {r.node: r.root for r in connected(spark.createDataFrame(
        members, "node string, grp string")).collect()}
    assert got == {v: least[find(v)] for v, _ in members}


def test_similarity_in_a_task_equals_the_column(spark):
    rng = random.Random(1)
    letters = ["a", "b", "ab", "abc", "caspian", "king", "kings", "خانه"]
    pairs = [(" ".join(rng.choices(letters, k=rng.randrange(0, 4))),
              " ".join(rng.choices(letters, k=rng.randrange(0, 4)))) for _ in range(400)]
    df = spark.createDataFrame(pairs, "a string, b string").withColumn("s", token_set_ratio("a", "b"))
    assert all(abs(r.s - token_set_ratio_of(r.a, r.b)) < 1e-9 for r in df.collect())
    assert df.where(F.col("s") > 0).count() > 50


def test_a_city_of_a_few_ten_thousand_rows_is_walked(spark, monkeypatch):
    """At 60 times sf0.1 a city has 38,000 rows; by components and rounds that did not end in time."""
    def no(*_):
        raise AssertionError("not walked as a whole")

    monkeypatch.setattr(resolve, "influence", no)
    monkeypatch.setattr(resolve, "_in_rounds", no)
    listings = spark.range(38_000).selectExpr(
        "'osm' AS source_id", "concat('c', id) AS external_id", "1L AS city_id",
        "concat('Shop ', id % 200) AS name", "30D + id % 6 * 0.5D AS lat", "10D + id % 10 * 0.5D AS lng",
        "array(named_struct('kind', 'website', 'value', concat('site', id % 37), 'url', 'u')) AS links")
    entities = spark.createDataFrame([], ENTITY)
    records = spark.createDataFrame([], "source_id string, external_id string, business_id string")
    held = spark.createDataFrame([], "business_id string, kind string, value string")
    got = resolve.resolve_entities(listings, entities, records, held).groupBy("stage").count().collect()
    # 30 spots with one entity for each of the 37 sites, if no name joins them before
    assert sum(r["count"] for r in got) == 38_000 and {r["stage"] for r in got} >= {"link", "new"}


@pytest.mark.parametrize("city_rows", [0, 10_000])
def test_results_do_not_depend_on_the_bounds(spark, city_rows):
    """Components beyond the walk's bound were settled in rounds, which took known entities first."""
    rows, held, links = world(5, 90)
    listings, entities = spark.createDataFrame(rows, LISTING), spark.createDataFrame(held, ENTITY)
    got = {(r.source_id, r.external_id): (r.business_id, r.stage) for r in resolve.resolve_entities(
        listings, entities, spark.createDataFrame([], "source_id string, external_id string, "
                                                  "business_id string"),
        spark.createDataFrame(links, "business_id string, kind string, value string"),
        city_rows=city_rows, walk_rows=4).collect()}
    plain, base = prepared(spark, listings, entities)
    assert got == one_at_a_time(plain, base, links)


def test_cells_hold_all_in_reach():
    """Around the poles and the line where longitudes start again as well."""
    rng = random.Random(6)
    for lat, lng in ((43.7, -79.4), (0.0, 180.0), (-60.0, -180.0), (89.95, 0.0), (-89.8, 179.0), (85.0, 180.0)):
        grid, spots = resolve.Grid(1000), []
        for i in range(120):
            x = lng + rng.uniform(-1, 1) * min(180, 0.012 / max(0.001, math.cos(math.radians(lat))))
            at = (max(-90.0, min(90.0, lat + rng.uniform(-0.012, 0.012))), (x + 180) % 360 - 180)
            spots.append(at)
            grid.put(at, "", f"{i:03d}")
        near = [{q for q in spots if resolve._apart(p, q) <= 1000} for p in spots]
        assert all(n <= {q for (q, _), _ in grid.around(p)} for p, n in zip(spots, near))
        assert 120 < sum(map(len, near)) < 120 * 120
