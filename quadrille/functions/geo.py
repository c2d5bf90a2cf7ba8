"""Geometry as arrays of (lon, lat) structs: kinds, measures and text forms, all as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The sphere's radius in metres, and the tolerance of closed lines in degrees.
EARTH_RADIUS = 6371008.8
CLOSED_TOLERANCE = 1e-9


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def point(lon: Column | str, lat: Column | str) -> Column:
    return F.struct(col(lon).cast("double").alias("lon"), col(lat).cast("double").alias("lat"))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def steps(pts: Column | str) -> Column:
    """Array of (a, b): each point with the next one; empty below two points."""
    p = col(pts)
    n = F.greatest(F.size(p) - 1, F.lit(0))
    return F.zip_with(F.slice(p, 1, n), F.slice(p, 2, n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def is_closed(pts: Column | str) -> Column:
    """At least four points of which the last is the first."""
    p = col(pts)
    a, z = F.try_element_at(p, F.lit(1)), F.try_element_at(p, F.lit(-1))
    return F.coalesce((F.size(p) >= 4) & (F.abs(a["lon"] - z["lon"]) < CLOSED_TOLERANCE) & (F.abs(a["lat"] - z["lat"]) < CLOSED_TOLERANCE), F.lit(False))


def line_kind(pts: Column | str) -> Column:
    """Empty, Point, Polygon (closed) or LineString."""
    p = col(pts)
    return F.when(F.size(p) <= 0, "Empty").when(F.size(p) == 1, "Point").when(is_closed(p), "Polygon").otherwise("LineString")


def dimension(kind: Column | str) -> Column:
    return F.when(col(kind).isin("Point", "MultiPoint"), 0).when(col(kind).isin("LineString", "MultiLineString"), 1).when(col(kind).isin("Polygon", "MultiPolygon"), 2)


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres."""
    half = lambda x, y: F.sin(F.radians(y - x) / 2)
    h = half(lat1, lat2) * half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2) * half(lon1, lon2)
    return 2 * EARTH_RADIUS * F.atan2(F.sqrt(h), F.sqrt(1 - h))


def line_length(pts: Column | str) -> Column:
    """Metres along a line; a ring's perimeter; 0 for a point."""
    return total(F.transform(steps(pts), lambda s: haversine(s["a"]["lat"], s["a"]["lon"], s["b"]["lat"], s["b"]["lon"])))


def ring_area(pts: Column | str) -> Column:
    """Square metres on the sphere inside a ring; 0 below four points."""
    parts = F.transform(steps(pts), lambda s: (F.radians(s["b"]["lon"]) - F.radians(s["a"]["lon"])) * (F.sin(F.radians(s["a"]["lat"])) + F.sin(F.radians(s["b"]["lat"]))))
    return F.when(F.size(col(pts)) < 4, 0.0).otherwise(F.abs(total(parts)) * EARTH_RADIUS * EARTH_RADIUS / 2)


def signed_area(pts: Column | str) -> Column:
    """Planar area in square degrees, negative for counter-clockwise rings."""
    return total(F.transform(steps(pts), lambda s: (s["b"]["lon"] - s["a"]["lon"]) * (s["b"]["lat"] + s["a"]["lat"]))) / 2


def mean_point(pts: Column | str) -> Column:
    """Mean of the vertices, a closing one included."""
    p = col(pts)
    mean = lambda f: total(F.transform(p, lambda x: x[f])) / F.size(p)
    return F.when(F.size(p) > 0, point(mean("lon"), mean("lat")))


def planar_centroid(pts: Column | str) -> Column:
    """Area-weighted for a ring, length-weighted for a line, the point itself for a point."""
    p = col(pts)
    s = steps(p)
    cross = lambda x: x["a"]["lon"] * x["b"]["lat"] - x["b"]["lon"] * x["a"]["lat"]
    flat = lambda x: F.sqrt(F.pow(x["b"]["lon"] - x["a"]["lon"], F.lit(2.0)) + F.pow(x["b"]["lat"] - x["a"]["lat"], F.lit(2.0)))
    area, length = total(F.transform(s, cross)), total(F.transform(s, flat))
    ring = lambda f: total(F.transform(s, lambda x: (x["a"][f] + x["b"][f]) * cross(x))) / (3 * area)
    line = lambda f: total(F.transform(s, lambda x: (x["a"][f] + x["b"][f]) / 2 * flat(x))) / length
    found = F.when(is_closed(p) & (F.abs(area) > 0), point(ring("lon"), ring("lat"))).when(length > 0, point(line("lon"), line("lat")))
    return found.otherwise(F.try_element_at(p, F.lit(1)))


def in_ring(lon: Column, lat: Column, pts: Column | str) -> Column:
    """Whether a point lies inside a ring, by the edges that a ray to the east crosses."""
    crossings = F.filter(
        steps(pts),
        lambda s: ((s["a"]["lat"] > lat) != (s["b"]["lat"] > lat)) & (lon < (s["b"]["lon"] - s["a"]["lon"]) * (lat - s["a"]["lat"]) / F.nullif(s["b"]["lat"] - s["a"]["lat"], F.lit(0.0)) + s["a"]["lon"]),
    )
    return F.size(crossings) % 2 == 1


def envelope(pts: Column | str) -> Column:
    p = col(pts)
    side = lambda f, g: g(F.transform(p, lambda x: x[f]))
    return F.struct(side("lon", F.array_min).alias("west"), side("lat", F.array_min).alias("south"), side("lon", F.array_max).alias("east"), side("lat", F.array_max).alias("north"))


def crosses_box(pts: Column | str, west: float, south: float, east: float, north: float) -> Column:
    """Whether a line touches a box, also where no vertex lies inside: each segment is clipped by the box's two strips."""

    def strip(a: Column, b: Column, low: float, high: float) -> tuple[Column, Column]:
        flat = a == b
        t, u = (F.lit(low) - a) / F.nullif(b - a, F.lit(0.0)), (F.lit(high) - a) / F.nullif(b - a, F.lit(0.0))
        return F.when(flat, F.when(a.between(low, high), 0.0).otherwise(2.0)).otherwise(F.least(t, u)), F.when(flat, 1.0).otherwise(F.greatest(t, u))

    def touches(s: Column) -> Column:
        (x0, x1), (y0, y1) = strip(s["a"]["lon"], s["b"]["lon"], west, east), strip(s["a"]["lat"], s["b"]["lat"], south, north)
        return F.greatest(x0, y0, F.lit(0.0)) <= F.least(x1, y1, F.lit(1.0))

    first = F.try_element_at(col(pts), F.lit(1))
    alone = (F.size(col(pts)) == 1) & first["lon"].between(west, east) & first["lat"].between(south, north)
    return F.coalesce(alone, F.lit(False)) | F.exists(steps(pts), touches)


# Text forms ------------------------------------------------------------------


def _list(pts: Column, between: str = " ", separator: str = ",", tail: str = "") -> Column:
    return F.array_join(F.transform(pts, lambda p: F.concat(p["lon"].cast("string"), F.lit(between), p["lat"].cast("string"), F.lit(tail))), separator)


def _rings(rings: Column, each) -> Column:
    return F.array_join(F.transform(rings, each), ",")


def wkt(kind: Column, pts: Column, outers: Column, inners: Column) -> Column:
    """Well-known text; inner rings belong to the first outer ring."""
    ring = lambda r: F.concat(F.lit("("), _list(r), F.lit(")"))
    first = F.concat(F.slice(outers, 1, 1), inners)
    polygon = F.concat(F.lit("("), _rings(first, ring), F.lit(")"))
    rest = _rings(F.slice(outers, 2, F.greatest(F.size(outers) - 1, F.lit(0))), lambda r: F.concat(F.lit("("), ring(r), F.lit(")")))
    return (
        F.when(kind == "Point", F.concat(F.lit("POINT("), _list(pts), F.lit(")")))
        .when(kind == "LineString", F.concat(F.lit("LINESTRING("), _list(pts), F.lit(")")))
        .when(kind == "Polygon", F.concat(F.lit("POLYGON"), polygon))
        .when(kind == "MultiPolygon", F.concat(F.lit("MULTIPOLYGON("), F.concat_ws(",", polygon, rest), F.lit(")")))
        .otherwise("GEOMETRYCOLLECTION()")
    )


def parse_wkt(text: Column | str) -> Column:
    """(kind, pts, rings) of a point, line string or polygon; an address of the reference system in front is skipped."""
    body = F.trim(F.regexp_replace(col(text), r"^\s*<[^>]*>", ""))
    kind = F.upper(F.regexp_extract(body, r"^([A-Za-z]+)", 1))
    inside = F.regexp_extract(body, r"^[A-Za-z]+\s*\((.*)\)\s*$", 1)
    pair = lambda p: point(F.try_element_at(F.split(F.trim(p), r"\s+"), F.lit(1)), F.try_element_at(F.split(F.trim(p), r"\s+"), F.lit(2)))
    line = lambda t: F.transform(F.split(t, ","), pair)
    rings = F.transform(F.split(F.regexp_replace(inside, r"^\s*\(|\)\s*$", ""), r"\)\s*,\s*\("), line)
    name = F.when(kind == "POINT", "Point").when(kind == "LINESTRING", "LineString").when(kind == "POLYGON", "Polygon").otherwise("Empty")
    none = F.array().cast("array<struct<lon:double,lat:double>>")
    return F.struct(name.alias("kind"), F.when(kind.isin("POINT", "LINESTRING"), line(inside)).otherwise(none).alias("pts"), F.when(kind == "POLYGON", rings).otherwise(F.array().cast("array<array<struct<lon:double,lat:double>>>")).alias("rings"))


#: What JSON-LD readers take the names of GeoJSON from.
CONTEXT = "https://geojson.org/geojson-ld/geojson-context.jsonld"


def feature(id: Column, properties: list[tuple[str, Column]], tags: Column, geometry: Column, context: str | None = None, value=lambda k, v: v) -> Column:
    """A GeoJSON feature: given properties, then one for each tag, in order. ``value`` makes a tag's property of key and value; without ``id`` none is written."""
    text = lambda x: F.regexp_extract(F.to_json(F.struct(x.alias("x"))), r'^\{"x":([\s\S]*)\}$', 1)
    field = lambda k, v: F.concat(text(k), F.lit(":"), text(v))
    given = [field(F.lit(k), v) for k, v in properties]
    rest = F.transform(tags, lambda t: field(F.concat(F.lit("/tag/"), t["k"]), value(t["k"], t["v"])))
    head = '{"type":"Feature"' + (f',"@context":"{context}"' if context else "")
    own = F.lit("") if id is None else F.concat(F.lit(',"id":'), text(id))
    return F.concat(F.lit(head), own, F.lit(',"properties":{'), F.array_join(F.concat(F.array(*given), rest), ","), F.lit('},"geometry":'), F.coalesce(geometry, F.lit("null")), F.lit("}"))


def multi_line_geojson(lines: Column) -> Column:
    """A GeoJSON MultiLineString; null without lines."""
    return F.when(F.size(lines) > 0, F.to_json(F.struct(F.lit("MultiLineString").alias("type"), F.transform(lines, _pairs).alias("coordinates"))))


def _pairs(pts: Column) -> Column:
    return F.transform(pts, lambda p: F.array(p["lon"], p["lat"]))


def geojson(kind: Column, pts: Column, outers: Column, inners: Column) -> Column:
    """A GeoJSON geometry."""
    shape = lambda c: F.to_json(F.struct(kind.alias("type"), c.alias("coordinates")))
    first = F.transform(F.concat(F.slice(outers, 1, 1), inners), _pairs)
    rest = F.transform(F.slice(outers, 2, F.greatest(F.size(outers) - 1, F.lit(0))), lambda r: F.array(_pairs(r)))
    return (
        F.when(kind == "Point", shape(F.array(pts[0]["lon"], pts[0]["lat"])))
        .when(kind == "LineString", shape(_pairs(pts)))
        .when(kind == "Polygon", shape(first))
        .when(kind == "MultiPolygon", shape(F.concat(F.array(first), rest)))
        .otherwise('{"type":"GeometryCollection","geometries":[]}')
    )


# Names of the two XML forms.
GML_OPEN = ' xmlns:gml="http://www.opengis.net/gml/3.2" srsName="http://www.opengis.net/def/crs/OGC/1.3/CRS84"'


def _tag(name: str, *inside: Column | str, attributes: str = "") -> Column:
    return F.concat(F.lit(f"<{name}{attributes}>"), *[F.lit(x) if isinstance(x, str) else x for x in inside], F.lit(f"</{name}>"))


def gml(kind: Column, pts: Column, outers: Column, inners: Column) -> Column:
    """GML 3.2; null for an empty geometry."""
    ring = lambda r: _tag("gml:LinearRing", _tag("gml:posList", _list(r, separator=" ")))
    holes = F.array_join(F.transform(inners, lambda r: _tag("gml:interior", ring(r))), "")
    polygon = lambda r, more, a="": _tag("gml:Polygon", _tag("gml:exterior", ring(r)), more, attributes=a)
    member = lambda p: _tag("gml:surfaceMember", p)
    rest = F.array_join(F.transform(F.slice(outers, 2, F.greatest(F.size(outers) - 1, F.lit(0))), lambda r: member(polygon(r, ""))), "")
    return (
        F.when(kind == "Point", _tag("gml:Point", _tag("gml:pos", _list(pts)), attributes=GML_OPEN))
        .when(kind == "LineString", _tag("gml:LineString", _tag("gml:posList", _list(pts, separator=" ")), attributes=GML_OPEN))
        .when(kind == "Polygon", polygon(outers[0], holes, GML_OPEN))
        .when(kind == "MultiPolygon", _tag("gml:MultiSurface", member(polygon(outers[0], holes)), rest, attributes=GML_OPEN))
    )


def kml(kind: Column, pts: Column, outers: Column, inners: Column) -> Column:
    """KML with altitude 0; inner rings are repeated under every outer ring."""
    coordinates = lambda p: _tag("coordinates", _list(p, between=",", separator=" ", tail=",0"))
    ring = lambda r: _tag("LinearRing", coordinates(r))
    holes = F.array_join(F.transform(inners, lambda r: _tag("innerBoundaryIs", ring(r))), "")
    polygons = F.transform(outers, lambda r: _tag("Polygon", _tag("outerBoundaryIs", ring(r)), holes))
    return (
        F.when(kind == "Point", _tag("Point", coordinates(pts)))
        .when(kind == "LineString", _tag("LineString", coordinates(pts)))
        .when(kind == "Polygon", polygons[0])
        .when(kind == "MultiPolygon", _tag("MultiGeometry", F.array_join(polygons, "")))
    )
