"""Resolving listings to entities.

The rules are: the same record was seen before; else a shared link within 1 km; else within
150 m and a similar name; else a new entity. They are applied one listing at a time, in a fixed
order of sources and ids, so the result depends on what came before: a listing that joins an
entity lends it its links and fills its gaps.

No city has a say in another. A city of at most ``WALK`` listings and entities is walked in order by
one call, all cities at once. In a larger city, what can depend on what is still much less than
everything. Listings that share a link, have one name
in a city, have similar names within reach, or could both move an entity without a place, are
connected; nothing outside a component has a say in it (``influence``). Components come from
pointer doubling, so a line of neighbours costs the logarithm of its length. Each component is
walked alone, whatever its size, so the result is the same on either side of the bound.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vouch import fixed_values as fv
from vouch.functions import geo
from vouch.functions import text as tx
from vouch.functions.similarity import token_set_ratio_of
from vouch.operators.components import connected
from vouch.operators.lineage import cut
from vouch.operators.matching import KEY, record_match, with_name_keys
from vouch.operators.near_names import similar_names, similar_within

#: Most listings and known entities of a city that is walked as a whole, and most rows that a walk has
#: as Python objects at a time. Both bound work and memory only; the result does not depend on them.
WALK = 2_000_000


def source_rank(source_id: Column, order: tuple[str, ...] = fv.SOURCE_ORDER) -> Column:
    """Position of a source in the survivorship order; unknown sources come last."""
    ranks = F.create_map(*[F.lit(x) for i, s in enumerate(order) for x in (s, i)])
    return F.coalesce(F.try_element_at(ranks, source_id), F.lit(len(order)))


def order_key(order: tuple[str, ...] = fv.SOURCE_ORDER) -> Column:
    """One sortable text per listing: source position, then external id."""
    return F.concat(F.lpad(source_rank(F.col("source_id"), order).cast("string"), 3, "0"),
                    F.lit("|"), "source_id", F.lit("|"), "external_id")


def influence(open_: DataFrame, base: DataFrame, held_links: DataFrame) -> DataFrame:
    """(node, grp): open listings of one group may depend on each other.

    A superset of what the rules can need. An entity's links and names come from its members, which
    lie within 1 km of it or are without a place; so a name that an entity took over is that of a
    listing at most 1 km and 150 m away, or of one without a place. A known entity without a place
    gets that of its first located member, so all that share a link with it, or have its name or a
    similar one, count as one group.
    """
    links = _link_rows(open_.withColumnRenamed("_ord", "business_id")).select(
        F.col("business_id").alias("node"), "kind", "value").join(
        open_.select(F.col("_ord").alias("node"), "city_id"), "node")
    by_link = links.select("node", F.concat_ws("\u0001", F.lit("l"), "city_id", "kind", "value")
                           .alias("grp"))
    named = open_.select(F.col("_ord").alias("node"), "city_id", "lat", "lng",
                         F.explode(F.array_distinct(F.array_compact(F.concat("name_keys", F.array(
                             "fa_key", "latin_key"))))).alias("name")).where("name <> ''")
    nowhere = base.where("lat IS NULL OR lng IS NULL").withColumn(
        "node", F.concat(F.lit("\u0003"), "business_id"))
    named = named.unionByName(nowhere.select("node", "city_id", "lat", "lng", F.explode("name_keys")
                                             .alias("name")))
    by_name = named.select("node", _name_group("city_id", "name").alias("grp"))
    located = named.where("lat IS NOT NULL AND lng IS NOT NULL")
    right = located.select("city_id", F.col("name").alias("r_name"), F.col("lat").alias("r_lat"),
                           F.col("lng").alias("r_lng"))
    alike = similar_within(located.select("city_id", "name", "lat", "lng").distinct(),
                           right.distinct(), ["city_id"],
                           fv.SAME_LINK_METERS + fv.NEARBY_METERS, settle=cut)
    alike = alike.select("city_id", "name", "r_name").distinct()
    loose = named.where("lat IS NULL OR lng IS NULL").select("city_id", "name").distinct()
    everywhere = similar_names(loose, named.select("city_id", F.col("name").alias("r_name")),
                               ["city_id"], settle=cut)
    everywhere = loose.join(everywhere, "name").select("city_id", "name", "r_name")
    alike = cut(alike.unionByName(everywhere).where("name <> r_name"))
    pair = F.concat_ws("\u0001", F.lit("s"), "city_id", "name", "r_name")
    ends = alike.select("city_id", "name", pair.alias("grp")).unionByName(
        alike.select("city_id", F.col("r_name").alias("name"), pair.alias("grp")))
    # names stand for their listings: all of one name in a city are one group already
    by_likeness = ends.select(F.concat(F.lit("\u0002"), _name_group("city_id", "name")).alias("node"),
                              "grp")
    names = named.select("city_id", "name").distinct().select(
        F.concat(F.lit("\u0002"), _name_group("city_id", "name")).alias("node"),
        _name_group("city_id", "name").alias("grp"))
    entity = F.concat(F.lit("e\u0001"), "business_id").alias("grp")
    by_entity = links.join(nowhere.select("business_id", "city_id").join(held_links, "business_id"),
                           ["city_id", "kind", "value"]).select("node", entity)
    by_entity = by_entity.unionByName(nowhere.select("node", entity))
    return by_link.unionByName(by_name).unionByName(by_likeness).unionByName(names).unionByName(
        by_entity).unionByName(open_.select(F.col("_ord").alias("node"),
                                            F.concat(F.lit("o\u0001"), "_ord").alias("grp")))


def _name_group(city: str, name: str) -> Column:
    return F.concat_ws("\u0001", F.lit("n"), city, name)


def _related(open_: DataFrame, base: DataFrame, held_links: DataFrame, roots: DataFrame) -> DataFrame:
    """Known entities that a component can join at first sight: (root, entity columns, links)."""
    listed = open_.join(roots, "_ord")
    links = listed.select("root", "city_id", F.explode("links").alias("l")).select(
        "root", "city_id", "l.kind", "l.value").distinct()
    held = held_links.join(base.select("business_id", "city_id"), "business_id")
    shared = links.join(held, ["city_id", "kind", "value"]).groupBy("root", "business_id").agg(
        F.collect_set(F.struct("kind", "value")).alias("links"))
    located = "lat IS NOT NULL AND lng IS NOT NULL"
    near = listed.where(located).select("root", "city_id", "lat", "lng",
                                        F.get("name_keys", F.lit(0)).alias("name")).where(
        "name IS NOT NULL").distinct()
    named = base.where(located).select("business_id", "city_id", F.col("lat").alias("r_lat"),
                                       F.col("lng").alias("r_lng"),
                                       F.explode("name_keys").alias("r_name"))
    alike = similar_within(near, named, ["city_id"], fv.NEARBY_METERS, settle=cut)
    # one name of a city lies in one component, so this is at most a row a name of an entity
    same = near.select("root", "city_id", F.col("name").alias("r_name")).distinct().join(
        named, ["city_id", "r_name"])
    ids = shared.select("root", "business_id").unionByName(alike.select("root", "business_id")) \
        .unionByName(same.select("root", "business_id")).distinct()
    return ids.join(shared, ["root", "business_id"], "left").join(base, "business_id").select(
        "root", "business_id", "lat", "lng", "name_fa", "name_latin", "fa_key", "latin_key", "links")


def _apart(a: tuple[float, float], b: tuple[float, float]) -> float:
    p, q = math.radians(a[0]), math.radians(b[0])
    h = (math.sin((q - p) / 2) ** 2
         + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2)
    return 2 * fv.EARTH_RADIUS_METERS * math.asin(min(1.0, math.sqrt(h)))


class Grid:
    """The smallest id of each (point, name) in cells as wide as a reach in metres."""

    __slots__ = ("tall", "cells")

    def __init__(self, meters: float):
        self.tall = meters / geo.METERS_PER_DEGREE * 1.001
        self.cells: dict[tuple[int, int], dict[tuple, str]] = {}

    def _width(self, band: int) -> float:
        """Degrees of longitude that a cell of the band spans: the reach where the bands beside it
        are narrowest. At a pole a band is one cell."""
        far = (max(abs(band), abs(band + 1)) + 1) * self.tall
        return 360.0 if far >= 89.9 else self.tall / math.cos(math.radians(far))

    def _columns(self, lng: float, band: int) -> set[int]:
        width = self._width(band)
        if width == 360.0:
            return {0}
        turns = [x for x in (lng - 360, lng, lng + 360) if abs(x) <= 180 + 2 * width or x == lng]
        return {int(x // width) + c for x in turns for c in (-1, 0, 1)}

    def put(self, at: tuple[float, float], name: str, key: str) -> None:
        band = int(at[0] // self.tall)
        width = self._width(band)
        cell = self.cells.setdefault((band, 0 if width == 360.0 else int(at[1] // width)), {})
        if key < cell.get((at, name), key + " "):
            cell[at, name] = key

    def around(self, at: tuple[float, float]):
        """((point, name), id) of all in reach, and of some that are farther away."""
        band = int(at[0] // self.tall)
        for k in (band - 1, band, band + 1):
            for c in self._columns(at[1], k):
                yield from self.cells.get((k, c), {}).items()


class Holders:
    """The entities with one link: the smallest of all, of those without a place, of each point."""

    __slots__ = ("first", "nowhere", "placed")

    def __init__(self):
        self.first, self.nowhere, self.placed = None, [], Grid(fv.SAME_LINK_METERS)

    def add(self, key: str, at: tuple[float, float] | None) -> None:
        self.first = key if self.first is None else min(self.first, key)
        if at is None:
            heapq.heappush(self.nowhere, key)
        else:
            self.placed.put(at, "", key)


class Known:
    """What the walk needs of an entity; its links only while it has no place."""

    __slots__ = ("at", "links", "names", "keys")

    def __init__(self):
        self.at, self.links, self.names, self.keys = None, set(), set(), []


class Walk:
    """The entities of one city or component while its listings pass, one at a time, in order.

    Memory goes with the entities, not with the listings. Entities of one link or of one name at one
    point are folded to the smallest id, so a listing costs what is different within its reach.
    """

    def __init__(self, alike: Callable[[str, str], float] = token_set_ratio_of):
        self.alike = alike
        self.known: dict[str, Known] = {}
        self.links: dict[tuple[str, str], Holders] = defaultdict(Holders)
        self.named = Grid(fv.NEARBY_METERS)

    def place(self, key: str, row: dict) -> None:
        """An entity takes what it lacks from a row, and the row's links."""
        e = self.known.get(key)
        if e is None:
            e = self.known[key] = Known()
        if e.at is None and row["lat"] is not None and row["lng"] is not None:
            e.at = (row["lat"], row["lng"])
            for link in e.links:
                self.links[link].add(key, e.at)
            for name in e.keys:
                self.named.put(e.at, name, key)
            e.links = set()
        for name, normal in (("name_fa", "fa_key"), ("name_latin", "latin_key")):
            if name not in e.names and row[name] is not None:
                e.names.add(name)
                if row[normal]:
                    e.keys.append(row[normal])
                    if e.at is not None:
                        self.named.put(e.at, row[normal], key)
        for link in _links(row):
            if e.at is not None or link not in e.links:
                self.links[link].add(key, e.at)
            if e.at is None:
                e.links.add(link)

    def _by_link(self, at: tuple[float, float] | None, row: dict) -> str | None:
        best = None
        for link in _links(row):
            held = self.links.get(link)
            if held is None:
                continue
            if at is None:
                best = held.first if best is None else min(best, held.first)
                continue
            while held.nowhere and self.known[held.nowhere[0]].at is not None:
                heapq.heappop(held.nowhere)
            for key in held.nowhere[:1]:
                best = key if best is None else min(best, key)
            for (point, _), key in held.placed.around(at):
                if (best is None or key < best) and _apart(at, point) <= fv.SAME_LINK_METERS:
                    best = key
        return best

    def _by_name(self, at: tuple[float, float], name: str) -> str | None:
        best = None
        for (point, other), key in self.named.around(at):
            alike = self.alike(name, other)
            if alike >= fv.NAME_SIMILARITY_CUT:
                rank = (-alike, other != name, key)
                if (best is None or rank < best) and _apart(at, point) <= fv.NEARBY_METERS:
                    best = rank
        return None if best is None else best[2]

    def take(self, row: dict) -> tuple[str, str]:
        """(business_id, stage) of the next listing."""
        at = None if row["lat"] is None or row["lng"] is None else (row["lat"], row["lng"])
        found, stage = self._by_link(at, row), "link"
        if found is None and at is not None and row["name_keys"] and row["name_keys"][0]:
            found, stage = self._by_name(at, row["name_keys"][0]), "name"
        if found is None:
            found, stage = hashlib.sha256(
                f"{row['source_id']}|{row['external_id']}".encode()).hexdigest(), "new"
            self.known[found] = Known()
        self.place(found, row)
        return found, stage


def _links(row: dict) -> list[tuple[str, str]]:
    return [(x["kind"], x["value"]) for x in row["links"] or ()]


RESULT = (*KEY, "business_id", "stage")


def resolve_entities(listings: DataFrame, entities: DataFrame, records: DataFrame,
                     entity_links: DataFrame, *, order: tuple[str, ...] = fv.SOURCE_ORDER,
                     city_rows: int = WALK, walk_rows: int = WALK) -> DataFrame:
    """(key, business_id, stage): stage is record, link, name or new.

    ``listings``: source_id, external_id, city_id, name, lat, lng, links, one row per key.
    ``entities``: business_id, city_id, lat, lng, name_fa, name_latin. A listing joins the smallest
    entity of those that share a link with it, else the one of the most similar name (of equal
    ones that of the same name, then the smallest).
    """
    persian, latin = tx.split_name("name")
    todo = listings.select(*KEY, "city_id", "name", "lat", "lng", "links",
                           order_key(order).alias("_ord"), persian.alias("name_fa"),
                           latin.alias("name_latin"))
    todo = _with_both_keys(with_name_keys(todo, ("name",)))
    known = record_match(todo, records)
    done = known.withColumn("stage", F.lit("record"))
    open_ = cut(todo.join(known, KEY, "left_anti"))
    if open_.isEmpty():
        return done
    # records seen before keep their entity and lend it their links
    held_links = cut(entity_links.select("business_id", "kind", "value").unionByName(
        _link_rows(todo.join(known, KEY))).distinct())
    base = cut(_with_both_keys(with_name_keys(_entity_columns(entities), ("name_latin", "name_fa"))))
    cities = open_.select("city_id").unionByName(base.select("city_id")).groupBy("city_id").count()
    cities = cut(cities.withColumn("whole", F.col("count") <= city_rows))
    whole = cities.where("whole").select("city_id")
    nowhere = open_.where("city_id IS NULL").withColumn("root", F.concat(F.lit("o|"), "_ord"))
    city = F.concat(F.lit("c|"), F.col("city_id").cast("string")).alias("root")
    done = done.unionByName(_walked(
        open_.join(whole, "city_id").select("*", city).unionByName(nowhere),
        _with_links(base.join(whole, "city_id"), held_links).select("*", city), walk_rows))
    larger = cities.where("NOT whole AND city_id IS NOT NULL").select("city_id")
    if larger.isEmpty():
        return done
    return done.unionByName(_in_rounds(cut(open_.join(larger, "city_id")),
                                       cut(base.join(larger, "city_id")), held_links, walk_rows))


def _walked(open_: DataFrame, known: DataFrame, walk_rows: int) -> DataFrame:
    """What ``Walk`` finds for every ``root``: its rows come sorted, the entities first, and pass a
    batch at a time."""
    columns = ["root", "lat", "lng", "name_fa", "name_latin", "fa_key", "latin_key",
               F.transform("links", lambda x: F.struct(x["kind"], x["value"])).alias("links")]
    rows = open_.select(*KEY, "_ord", "name_keys", *columns, F.lit(True).alias("_listed")).unionByName(
        known.select("business_id", *columns, F.lit(False).alias("_listed")), allowMissingColumns=True)

    def walks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root, walk, alike = None, None, lru_cache(1 << 16)(token_set_ratio_of)
        parts = (b.slice(i, walk_rows) for b in batches for i in range(0, len(b), walk_rows))
        for part in parts:
            out: list[tuple[str, str, str, str]] = []
            for row in part.to_pylist():
                if walk is None or row["root"] != root:
                    root, walk = row["root"], Walk(alike)
                if row["_listed"]:
                    out.append((row["source_id"], row["external_id"], *walk.take(row)))
                else:
                    walk.place(row["business_id"], row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, pa.string()) for x in (zip(*out) if out else [[]] * len(RESULT))], RESULT)

    return rows.repartition("root").sortWithinPartitions("root", "_listed", "_ord").mapInArrow(
        walks, ", ".join(f"{c} string" for c in RESULT))


def _in_rounds(open_: DataFrame, base: DataFrame, held_links: DataFrame, walk_rows: int) -> DataFrame:
    """The listings of larger cities: each component is walked alone, one batch after the other,
    however many rows it has."""
    roots = connected(influence(open_, base, held_links)).withColumnRenamed("node", "_ord")
    roots = open_.select("_ord").join(roots, "_ord")
    return _walked(open_.join(roots, "_ord"), _related(open_, base, held_links, roots), walk_rows)


def _with_links(base: DataFrame, held_links: DataFrame) -> DataFrame:
    links = held_links.groupBy("business_id").agg(F.collect_set(F.struct("kind", "value")).alias("links"))
    return base.join(links, "business_id", "left")


def _with_both_keys(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"fa_key": tx.normalize_name("name_fa"),
                             "latin_key": tx.normalize_name("name_latin")})


def _link_rows(members: DataFrame) -> DataFrame:
    return members.select("business_id", F.explode("links").alias("l")).select(
        "business_id", "l.kind", "l.value")


def _entity_columns(entities: DataFrame) -> DataFrame:
    return entities.select("business_id", "city_id", "lat", "lng", "name_fa", "name_latin")
