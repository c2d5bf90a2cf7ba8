"""Selections of elements: by box, tag, type, radius and id."""

from __future__ import annotations

import math
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.functions.geo import EARTH_RADIUS, haversine
from quadrille.sources.elements import Elements

# Keys of points of interest, and metres of a degree of latitude.
POI_KEYS = "amenity|shop|tourism|leisure|healthcare"
DEGREE = EARTH_RADIUS * 3.141592653589793 / 180
TYPES = ("node", "way", "relation")


def parse_bbox(text: str) -> tuple[float, float, float, float]:
    """``west,south,east,north``."""
    parts = [float(x) for x in text.split(",")]
    if len(parts) != 4:
        raise ValueError("a box is west,south,east,north")
    return tuple(parts)


def in_bbox(bbox) -> Column:
    """On nodes, in whole 1e-7 degrees: plain comparisons of integer columns reach the Parquet scan."""
    west, south, east, north = (round(x * 1e7) for x in bbox)
    return F.col("lon7").between(west, east) & F.col("lat7").between(south, north)


def nodes_in(e: Elements, bbox) -> DataFrame:
    return e.nodes.where(in_bbox(bbox))


def ways_in(e: Elements, bbox) -> DataFrame:
    """Ways of which a node lies in the box."""
    inside = e.way_nodes.join(nodes_in(e, bbox).select(F.col("id").alias("node_id")), "node_id", "left_semi")
    return e.ways.join(inside.select(F.col("way_id").alias("id")), "id", "left_semi")


def relations_in(e: Elements, bbox) -> DataFrame:
    """Relations with a member node or way that is selected."""
    chosen = nodes_in(e, bbox).select(F.lit("node").alias("type"), F.col("id").alias("ref")).union(ways_in(e, bbox).select(F.lit("way"), "id"))
    return e.relations.join(e.relation_members.join(chosen, ["type", "ref"], "left_semi").select(F.col("rel_id").alias("id")), "id", "left_semi")


def all_elements(e: Elements, kind: str = "nwr") -> DataFrame:
    """(type, id) of the wanted types: any of the letters of ``nwr``, or a type's name."""
    wanted = [t for t in TYPES if kind == t or (kind not in TYPES and t[0] in kind)]
    if kind not in TYPES and (not kind or set(kind) - set("nwr")):
        raise ValueError(f"no such type: {kind}")
    tables = {"node": e.nodes, "way": e.ways, "relation": e.relations}
    parts = [tables[t].select(F.lit(t).alias("type"), "id") for t in wanted]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def all_tags(e: Elements) -> DataFrame:
    """(type, id, seq, k, v) of all elements."""
    parts = [(t, df) for t, df in zip(TYPES, (e.node_tags, e.way_tags, e.relation_tags))]
    tables = [df.select(F.lit(t).alias("type"), "id", "seq", "k", "v") for t, df in parts]
    return tables[0].unionByName(tables[1]).unionByName(tables[2])


def tag_condition(text: str | None) -> Column:
    """``key`` or ``key=value``, split at the first sign; blank holds always."""
    key, sign, value = (text or "").partition("=")
    if not key.strip():
        return F.lit(True)
    return (F.col("k") == key.strip()) & ((F.col("v") == value.strip()) if sign else F.lit(True))


def poi_condition() -> Column:
    return F.col("k").rlike(POI_KEYS) & (F.col("v") != "")


def distance_to(lon: float, lat: float) -> Column:
    return haversine(F.lit(lat), F.lit(lon), F.col("lat"), F.col("lon"))


def around(e: Elements, lon: float, lat: float, radius: float = 100.0) -> DataFrame:
    """Nodes within ``radius`` metres, with their distance; a box of latitudes is compared first."""
    margin = radius / DEGREE
    near = e.nodes.where(F.col("lat7").between(int((lat - margin) * 1e7) - 1, int((lat + margin) * 1e7) + 1))
    return near.withColumn("metres", distance_to(lon, lat)).where(F.col("metres") <= radius)


def around_pairs(left: DataFrame, right: DataFrame, radius: float) -> DataFrame:
    """Pairs (left_id, right_id, metres) of two tables (id, lon, lat) within ``radius`` metres, anywhere on the globe.

    Rows meet in cubes of the unit sphere's space as wide as the radius' chord;
    right rows stand in their own and those of the 26 neighbouring cubes that may
    hold a point within reach. So neither the poles nor the 180 degree meridian
    are special. Both sides are shuffled before the join is planned, which would
    take right rows for as few as they were and send a side through the driver.
    """
    # A little wider, so that rounding parts no pair.
    size = 2 * math.sin(min(radius / (2 * EARTH_RADIUS), math.pi / 2)) * (1 + 1e-9) + 1e-12

    def place(lon: str, lat: str) -> list[Column]:
        x, y = F.radians(lon), F.radians(lat)
        return [c / size for c in (F.cos(y) * F.cos(x), F.cos(y) * F.sin(x), F.sin(y))]

    names = ["cx", "cy", "cz"]
    a = left.select(F.col("id").alias("left_id"), F.col("lon").alias("lon1"), F.col("lat").alias("lat1"), *[F.floor(c).alias(n) for c, n in zip(place("lon", "lat"), names)]).repartition(*names)
    shifts = F.array(*[F.struct(*[F.lit(d).alias(n) for d, n in zip(ds, names)]) for ds in product((-1, 0, 1), repeat=3)])
    b = right.select(F.col("id").alias("right_id"), F.col("lon").alias("lon2"), F.col("lat").alias("lat2"), *[c.alias(n) for c, n in zip(place("lon", "lat"), names)])
    # How far the cube is along an axis, in cubes; the radius is one.
    gap = lambda n, d: F.when(d > 0, F.floor(n) + 1 - F.col(n)).when(d < 0, F.col(n) - F.floor(n)).otherwise(0.0)
    reached = F.filter(shifts, lambda s: sum(gap(n, s[n]) * gap(n, s[n]) for n in names) <= 1 + 1e-6)
    b = b.select("right_id", "lon2", "lat2", *names, F.explode(reached).alias("s"))
    b = b.select("right_id", "lon2", "lat2", *[(F.floor(n) + F.col(f"s.{n}")).alias(n) for n in names]).repartition(*names)
    metres = haversine(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"))
    return a.join(b, names).select("left_id", "right_id", metres.alias("metres")).where(F.col("metres") <= radius)


def search(places: DataFrame, text: str, limit: int = 10) -> DataFrame:
    """Places (id, name, importance) whose names hold all words of ``text``, most important first."""
    hit = F.lit(True)
    for word in text.lower().split():
        hit &= F.contains(F.lower("name"), F.lit(word))
    return places.where(hit).orderBy(F.desc("importance"), "id").limit(limit)
