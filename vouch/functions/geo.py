"""Distance, boxes and grid cells as column arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from vouch import fixed_values as fv
from vouch.functions.text import ColumnOrName, col

METERS_PER_DEGREE = fv.EARTH_RADIUS_METERS * math.pi / 180.0


def distance_m(lat1: ColumnOrName, lng1: ColumnOrName, lat2: ColumnOrName,
               lng2: ColumnOrName) -> Column:
    """Great-circle metres; null when any coordinate is null."""
    p1, p2 = F.radians(col(lat1)), F.radians(col(lat2))
    half_lat = (p2 - p1) / 2
    half_lng = F.radians(col(lng2) - col(lng1)) / 2
    h = F.pow(F.sin(half_lat), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(half_lng), 2)
    return 2 * fv.EARTH_RADIUS_METERS * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def in_box(lat: ColumnOrName, lng: ColumnOrName, west: ColumnOrName, south: ColumnOrName,
           east: ColumnOrName, north: ColumnOrName) -> Column:
    """Inclusive box test; a missing coordinate fails."""
    inside = col(lat).between(col(south), col(north)) & col(lng).between(col(west), col(east))
    return F.coalesce(inside, F.lit(False))


def metro_box(lat: ColumnOrName, lng: ColumnOrName, south: ColumnOrName, north: ColumnOrName,
              west: ColumnOrName, east: ColumnOrName) -> Column:
    """Struct (west, south, east, north): the box widened by a quarter per side and capped."""
    lat, lng = col(lat), col(lng)
    s, n = F.coalesce(col(south), lat), F.coalesce(col(north), lat)
    w, e = F.coalesce(col(west), lng), F.coalesce(col(east), lng)
    stretch = 1.0 / F.greatest(F.cos(F.radians(lat)), F.lit(0.2))
    grow = 1 + 2 * fv.WIDEN
    half_lat = F.least(F.greatest((n - s) / 2 * grow, F.lit(fv.MIN_HALF_SPAN)),
                       F.lit(fv.MAX_SPAN / 2))
    half_lng = F.least(F.greatest((e - w) / 2 * grow, fv.MIN_HALF_SPAN * stretch),
                       fv.MAX_SPAN / 2 * stretch)
    mid_lat, mid_lng = (s + n) / 2, (w + e) / 2
    return F.struct(
        F.round(mid_lng - half_lng, 3).alias("west"),
        F.round(mid_lat - half_lat, 3).alias("south"),
        F.round(mid_lng + half_lng, 3).alias("east"),
        F.round(mid_lat + half_lat, 3).alias("north"),
    )


def row_cell(lat: ColumnOrName, meters: float) -> Column:
    """Grid row of a latitude, rows being ``meters`` high."""
    return F.floor(col(lat) * (METERS_PER_DEGREE / meters)).cast("long")


def col_cell(lng: ColumnOrName, row: ColumnOrName, meters: float) -> Column:
    """Grid column inside a row: cells are ``meters`` wide at the row's edge nearest the
    pole, so they are at least that wide everywhere else in the row."""
    edge = F.greatest(F.abs(col(row)), F.abs(col(row) + 1)) * (meters / METERS_PER_DEGREE)
    return F.floor(col(lng) * width_per_degree(edge, meters)).cast("long")


def width_per_degree(edge_lat: Column, meters: float) -> Column:
    """Cells per degree of longitude at a latitude."""
    return F.greatest(F.cos(F.radians(F.least(edge_lat, F.lit(89.9)))), F.lit(1e-3)) * (
        METERS_PER_DEGREE / meters)
