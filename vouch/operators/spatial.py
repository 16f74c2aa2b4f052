"""Box joins and radius searches as grid-cell equi-joins.

No operator compares all pairs of a group. ``min_id_within`` in particular stays near-linear
when one key holds most rows: points are folded into sub-cells, sub-cells are compared by
bounding boxes, and single points are compared only where the boxes cannot decide and could
still improve the answer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vouch.functions import geo


def city_box_join(points: DataFrame, cities: DataFrame, *, cell: float = 1.0,
                  same: tuple[str, ...] = (), lat: str = "lat", lng: str = "lng") -> DataFrame:
    """Every (point, city) pair whose box covers the point, edges included.

    Boxes are exploded to the grid cells they touch, so the join is an equi-join on the cell
    (plus the ``same`` columns) with the exact test as a residual. The box side is small and
    one row per touched cell; adaptive execution splits a hot cell on the point side.
    """
    def steps(lo: str, hi: str) -> Column:
        return F.sequence(F.floor(F.col(lo) / cell).cast("long"),
                          F.floor(F.col(hi) / cell).cast("long"))

    boxes = (cities.where((F.col("west") <= F.col("east")) & (F.col("south") <= F.col("north")))
             .withColumn("_cx", F.explode(steps("west", "east")))
             .withColumn("_cy", F.explode(steps("south", "north"))))
    pts = (points.where(F.col(lat).isNotNull() & F.col(lng).isNotNull())
           .withColumn("_cx", F.floor(F.col(lng) / cell).cast("long"))
           .withColumn("_cy", F.floor(F.col(lat) / cell).cast("long")))
    joined = pts.join(boxes, ["_cx", "_cy", *same])
    inside = geo.in_box(lat, lng, "west", "south", "east", "north")
    return joined.where(inside).drop("_cx", "_cy")


def covering_city(points: DataFrame, cities: DataFrame, key: str, *, lat: str = "lat",
                  lng: str = "lng") -> DataFrame:
    """(key, slug) of the smallest city box of the point's country that covers the point."""
    boxes = cities.select("slug", "country_code", "west", "south", "east", "north")
    pairs = city_box_join(points.select(key, "country_code", lat, lng), boxes,
                          same=("country_code",), lat=lat, lng=lng)
    area = (F.col("east") - F.col("west")) * (F.col("north") - F.col("south"))
    return pairs.groupBy(key).agg(F.min(F.struct(area.alias("area"), "slug"))["slug"]
                                  .alias("slug"))


def _haversine(dlat: Column, dlng: Column, cos_product: Column) -> Column:
    h = (F.pow(F.sin(F.radians(dlat) / 2), 2)
         + cos_product * F.pow(F.sin(F.radians(F.least(dlng, F.lit(180.0))) / 2), 2))
    return 2 * geo.fv.EARTH_RADIUS_METERS * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def _box_bounds(a: str, b: str) -> tuple[Column, Column]:
    """Lower and upper bound of the distance between points of two lat/lng boxes."""
    c = F.col
    zero = F.lit(0.0)
    lat_gap = F.greatest(zero, c(f"{b}lat_lo") - c(f"{a}lat_hi"), c(f"{a}lat_lo") - c(f"{b}lat_hi"))
    lng_gap = F.greatest(zero, c(f"{b}lng_lo") - c(f"{a}lng_hi"), c(f"{a}lng_lo") - c(f"{b}lng_hi"))
    lat_far = F.greatest(c(f"{b}lat_hi") - c(f"{a}lat_lo"), c(f"{a}lat_hi") - c(f"{b}lat_lo"))
    lng_far = F.greatest(c(f"{b}lng_hi") - c(f"{a}lng_lo"), c(f"{a}lng_hi") - c(f"{b}lng_lo"))

    def cos2(edges: list[Column], pick) -> Column:
        return F.pow(pick(*[F.cos(F.radians(e)) for e in edges]), 2)

    edges = [c(f"{x}lat_{y}") for x in (a, b) for y in ("lo", "hi")]
    # cos is largest at the edge nearest the equator; 1 when a box straddles it
    straddles = F.least(*edges) * F.greatest(*edges) <= 0
    upper = F.when(straddles, F.lit(1.0)).otherwise(cos2(edges, F.greatest))
    return (_haversine(lat_gap, lng_gap, cos2(edges, F.least)),
            _haversine(lat_far, lng_far, upper))


def with_neighbour_cells(points: DataFrame, meters: float, *, lat_lo: str, lat_hi: str,
                         lng_lo: str, lng_hi: str) -> DataFrame:
    """One row per grid cell that can hold a point within ``meters`` of the row's box."""
    reach = meters / geo.METERS_PER_DEGREE
    rows = F.sequence(geo.row_cell(F.col(lat_lo) - reach, meters),
                      geo.row_cell(F.col(lat_hi) + reach, meters))
    far = F.least(F.greatest(F.abs(F.col(lat_lo)), F.abs(F.col(lat_hi))) + reach, F.lit(89.9))
    delta = reach / F.cos(F.radians(far)) * 1.001
    df = points.withColumn("_row", F.explode(rows))
    cols = F.sequence(geo.col_cell(F.col(lng_lo) - delta, "_row", meters),
                      geo.col_cell(F.col(lng_hi) + delta, "_row", meters))
    return df.withColumn("_col", F.explode(cols))


def with_cell(points: DataFrame, meters: float, *, lat: str = "lat", lng: str = "lng",
              row: str = "_row", column: str = "_col") -> DataFrame:
    df = points.withColumn(row, geo.row_cell(lat, meters))
    return df.withColumn(column, geo.col_cell(lng, row, meters))


def pairs_within(left: DataFrame, right: DataFrame, keys: list[str], meters: float) -> DataFrame:
    """Pairs of located rows with equal keys at most ``meters`` apart.

    ``left`` has lat, lng; ``right`` has r_lat, r_lng. Callers fold duplicates first.
    """
    near = with_neighbour_cells(left, meters, lat_lo="lat", lat_hi="lat", lng_lo="lng",
                                lng_hi="lng")
    cells = with_cell(right, meters, lat="r_lat", lng="r_lng")
    joined = near.join(cells, [*keys, "_row", "_col"]).drop("_row", "_col")
    return joined.where(geo.distance_m("lat", "lng", "r_lat", "r_lng") <= meters)


def min_id_within(left: DataFrame, right: DataFrame, keys: list[str], meters: float,
                  ident: str) -> DataFrame:
    """(keys..., lat, lng, ident): for each distinct point of ``left`` the smallest ``ident``
    of ``right`` with equal keys at most ``meters`` away; points without one are left out.

    Exact. Emits per pair of occupied sub-cells, not per pair of points: sub-cells that lie
    wholly within reach answer for all their points, and the points of a border sub-cell are
    compared only if its smallest id would beat the answer already certain.
    """
    fine = meters / 8
    box = [F.min("lat").alias("lat_lo"), F.max("lat").alias("lat_hi"),
           F.min("lng").alias("lng_lo"), F.max("lng").alias("lng_hi")]
    located = F.col("lat").isNotNull() & F.col("lng").isNotNull()

    pts = with_cell(left.where(located).select(*keys, "lat", "lng").distinct(), fine,
                    row="_lr", column="_lc")
    ids = right.where(located).groupBy(*keys, "lat", "lng").agg(F.min(ident).alias(ident))
    ids = with_cell(with_cell(ids, meters), fine, row="_rr", column="_rc")
    # sub-cells are grouped under their coarse cell, which is what the join is on
    left_cells = pts.groupBy(*keys, "_lr", "_lc").agg(*box)
    right_cells = ids.groupBy(*keys, "_row", "_col", "_rr", "_rc").agg(
        F.min(ident).alias(ident), *[b.alias("r_" + n) for b, n in zip(
            (F.min("lat"), F.max("lat"), F.min("lng"), F.max("lng")),
            ("lat_lo", "lat_hi", "lng_lo", "lng_hi"), strict=True)])
    near = with_neighbour_cells(left_cells, meters, lat_lo="lat_lo", lat_hi="lat_hi",
                                lng_lo="lng_lo", lng_hi="lng_hi")
    low, high = _box_bounds("", "r_")
    pairs = (near.join(right_cells, [*keys, "_row", "_col"])
             .withColumn("_low", low).withColumn("_high", high)
             .where(F.col("_low") <= meters))
    cell_key = [*keys, "_lr", "_lc"]
    certain = F.when(F.col("_high") <= meters, F.col(ident))
    # per left sub-cell: the certain answer, and the border sub-cells that could beat it
    summary = pairs.groupBy(*cell_key).agg(
        F.min(certain).alias("_sure"),
        F.collect_list(F.when(F.col("_high") > meters, F.struct(
            F.col(ident).alias("best"), "_row", "_col", "_rr", "_rc"))).alias("_open"))
    open_cells = F.filter("_open", lambda o: F.coalesce(o["best"] < F.col("_sure"), F.lit(True)))
    hits = pts.join(summary.withColumn("_open", open_cells), cell_key)
    border = hits.select(*keys, "lat", "lng", "_sure", F.explode_outer("_open").alias("_o")).select(
        *keys, "lat", "lng", "_sure", "_o._row", "_o._col", "_o._rr", "_o._rc")
    far = ids.select(*keys, "_row", "_col", "_rr", "_rc", F.col(ident).alias("_far"),
                     F.col("lat").alias("r_lat"), F.col("lng").alias("r_lng"))
    tried = border.join(far, [*keys, "_row", "_col", "_rr", "_rc"], "left")
    exact = F.when(geo.distance_m("lat", "lng", "r_lat", "r_lng") <= meters, F.col("_far"))
    # least() skips nulls
    found = tried.groupBy(*keys, "lat", "lng").agg(F.min(F.least("_sure", exact)).alias(ident))
    return found.where(F.col(ident).isNotNull())
