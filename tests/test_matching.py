"""Radius searches and entity matching against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from vouch.operators import matching, spatial

R = 6371008.8


def meters(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = (math.sin((q - p) / 2) ** 2
         + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2)
    return 2 * R * math.asin(math.sqrt(h))


def cloud(seed, n, centre, spread):
    rng = random.Random(seed)
    return [(rng.choice("ab"), centre[0] + rng.uniform(-spread, spread),
             centre[1] + rng.uniform(-spread, spread), f"e{rng.randrange(10**6):06d}")
            for _ in range(n)]


@pytest.mark.parametrize(("centre", "spread", "reach"), [
    ((43.7, -79.4), 0.02, 1000.0), ((-33.9, 151.2), 0.004, 150.0), ((0.0, 0.0), 0.02, 1000.0),
    ((69.6, 18.9), 0.01, 1000.0),
])
def test_min_id_within_equals_brute_force(spark, centre, spread, reach):
    left, right = cloud(1, 250, centre, spread), cloud(2, 300, centre, spread)
    schema = "k string, lat double, lng double, id string"
    got = spatial.min_id_within(spark.createDataFrame(left, schema).drop("id"),
                                spark.createDataFrame(right, schema), ["k"], reach, "id")
    got = {(r.k, r.lat, r.lng): r.id for r in got.collect()}
    want = {}
    for k, lat, lng, _ in left:
        ids = [i for kk, la, ln, i in right if kk == k and meters((lat, lng), (la, ln)) <= reach]
        if ids:
            want[k, lat, lng] = min(ids)
    assert len(want) > 20 and got == want


def test_pairs_within_equals_brute_force(spark):
    left, right = cloud(3, 150, (51.5, -0.1), 0.01), cloud(4, 150, (51.5, -0.1), 0.01)
    ldf = spark.createDataFrame(left, "k string, lat double, lng double, l string")
    rdf = spark.createDataFrame(right, "k string, r_lat double, r_lng double, r string")
    got = {(x.l, x.r) for x in spatial.pairs_within(ldf, rdf, ["k"], 150.0).collect()}
    want = {(i, j) for k, la, ln, i in left for kk, lb, lo, j in right
            if k == kk and meters((la, ln), (lb, lo)) <= 150.0}
    assert got == want and want


LISTING = "source_id string, external_id string, city_id long, name string, lat double, " \
          "lng double, links array<struct<kind:string,value:string,url:string>>"
ENTITY = "business_id string, city_id long, lat double, lng double, name_latin string, " \
         "name_fa string"


def test_link_match_rules(spark):
    ig = [("instagram", "shiraz", "u")]
    listings = spark.createDataFrame([
        ("osm", "near", 1, "x", 43.7022, -79.4005, ig),
        ("osm", "far", 1, "x", 43.80, -79.40, ig),
        ("osm", "nowhere", 1, "x", None, None, ig),
        ("osm", "other city", 2, "x", 43.70, -79.40, ig),
        ("osm", "no links", 1, "x", 43.70, -79.40, []),
    ], LISTING)
    entities = spark.createDataFrame([
        ("b1", 1, 43.70, -79.40, "A", None), ("b2", 1, 43.7001, -79.40, "B", None),
    ], ENTITY)
    links = spark.createDataFrame([("b1", "instagram", "shiraz"), ("b2", "instagram", "shiraz")],
                                  "business_id string, kind string, value string")
    got = {r.external_id: r.business_id
           for r in matching.link_match(listings, entities, links).collect()}
    assert got == {"near": "b1", "nowhere": "b1"}
    unlocated = entities.withColumn("lat", F.when(F.col("business_id") != "b2", F.col("lat")))
    got = {r.external_id: r.business_id
           for r in matching.link_match(listings, unlocated, links).collect()}
    assert got == {"near": "b1", "far": "b2", "nowhere": "b1"}


def test_nearby_match_rules(spark):
    listings = spark.createDataFrame([
        ("osm", "same", 1, "Shiraz Kitchen Restaurant", 43.7005, -79.40, []),
        ("osm", "typo", 1, "Shirazz", 43.7005, -79.40, []),
        ("osm", "far", 1, "Shiraz Kitchen", 43.80, -79.40, []),
        ("osm", "different", 1, "Tehran Grill", 43.7005, -79.40, []),
        ("osm", "generic", 1, "The Restaurant", 43.7005, -79.40, []),
    ], LISTING)
    entities = spark.createDataFrame([
        ("b1", 1, 43.70, -79.40, "Shiraz House", None),
        ("b2", 1, 43.70, -79.40, "Shiraz Kitchen", "شیراز"),
    ], ENTITY)
    rows = matching.nearby_match(listings, entities).collect()
    got = {r.external_id: (r.business_id, round(r.similarity, 1)) for r in rows}
    assert got == {"same": ("b2", 100.0), "typo": ("b2", 92.3)}
    rows = matching.nearby_match(listings, entities, smallest=True).collect()
    assert {r.external_id: r.business_id for r in rows} == {"same": "b1", "typo": "b2"}


def test_city_boxes(spark):
    cities = spark.createDataFrame([
        ("la", "US", -118.95, 33.60, -117.65, 34.35), ("irvine", "US", -117.9, 33.6, -117.7, 33.8),
        ("edge", "US", -118.0, 33.0, -117.0, 34.0), ("x", "FR", -119.0, 33.0, -117.0, 35.0),
    ], "slug string, country_code string, west double, south double, east double, north double")
    points = spark.createDataFrame([
        ("p1", "US", 33.7, -117.8), ("p2", "US", 34.35, -118.95), ("p3", "US", 10.0, 10.0),
        ("p4", "US", None, None)], "id string, country_code string, lat double, lng double")
    pairs = spatial.city_box_join(points.drop("country_code"), cities)
    got = {(r.id, r.slug) for r in pairs.select("id", "slug").collect()}
    assert got == {("p1", "la"), ("p1", "irvine"), ("p1", "edge"), ("p1", "x"), ("p2", "la"),
                   ("p2", "x")}
    smallest = spatial.covering_city(points, cities, "id").collect()
    assert {(r.id, r.slug) for r in smallest} == {("p1", "irvine"), ("p2", "la")}
