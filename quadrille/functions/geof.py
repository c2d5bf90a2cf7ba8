"""Functions over WKT literals, for patterns over triples: measures, dimension, centroid, GeoJSON.

A text of any kind, also with an address of its reference system in front, is
taken apart to an array of parts (dim, rings): a point is one ring of one point,
a line one ring, a polygon its outer ring and its holes; kinds of several parts
and collections are more parts. An empty geometry has no parts. A text that
isn't understood, a line of one point and a ring that is open or has fewer than
four points are errors: null, and so is all that is made of them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quadrille.functions.geo import _pairs, col, haversine, line_length, point, ring_area, steps, total

PARTS = "array<struct<dim:int,rings:array<array<struct<lon:double,lat:double>>>>>"


def _let(value: Column, make) -> Column:
    """``make`` of a value that is computed once."""
    return F.transform(F.array(value), make)[0]


def kind(wkt: Column | str) -> Column:
    """POINT, POLYGON and so on; empty where the text isn't WKT."""
    return F.upper(F.regexp_extract(_body(wkt), r"^([A-Za-z]+)\s*(?:\(|EMPTY|empty)", 1))


def _body(wkt: Column | str) -> Column:
    return F.trim(F.regexp_replace(col(wkt), r"^\s*<[^>]*>", ""))


def _line(text: Column) -> Column:
    number = lambda words, i: F.try_element_at(words, F.lit(i)).try_cast("double")
    return F.transform(F.split(text, ","), lambda p: _let(F.split(F.trim(F.translate(p, "()", "  ")), r"\s+"), lambda words: point(number(words, 1), number(words, 2))))


def _rings(text: Column) -> Column:
    """Rings of ``(x y, x y), (x y, x y)``."""
    return F.transform(F.split(text, r"\)\s*,\s*\("), _line)


def _of_one(text: Column) -> Column:
    """Parts of a text that isn't a collection."""

    def made(x: Column) -> Column:
        name, inside = x["name"], x["inside"]
        # Each kind of several parts is cut where its parts meet.
        between = F.when(name == "MULTIPOINT", ",").when(name == "MULTIPOLYGON", r"\)\s*\)\s*,\s*\(\s*\(").when(name == "MULTILINESTRING", r"\)\s*,\s*\(")
        cut = F.when(between.isNull(), F.array(inside)).otherwise(F.split(inside, between))
        dim = F.when(name.endswith("POINT"), 0).when(name.endswith("LINESTRING"), 1).when(name.endswith("POLYGON"), 2)
        known = name.isin("POINT", "LINESTRING", "POLYGON", "MULTIPOINT", "MULTILINESTRING", "MULTIPOLYGON")
        return F.when(known & (inside != ""), F.transform(cut, lambda t: F.struct(dim.alias("dim"), _rings(t).alias("rings"))))

    def read(t: Column) -> Column:
        name = F.upper(F.regexp_extract(t, r"^\s*([A-Za-z]+)", 1))
        inside = F.regexp_extract(t, r"^\s*[A-Za-z]+[^(]*\(([\s\S]*)\)\s*$", 1)
        return F.when(t.rlike(r"(?i)^\s*[A-Z]+\s+EMPTY\s*$"), F.array().cast(PARTS)).otherwise(_let(F.struct(name.alias("name"), inside.alias("inside")), made))

    return _let(text, read)


def parts(wkt: Column | str) -> Column:
    """The parts of a text, null where it is an error."""

    def members(text: Column) -> Column:
        plain = F.regexp_replace(F.regexp_replace(text, r"(?i)GEOMETRYCOLLECTION\s*\(", ""), r"^\s*,|\)\s*$", "")
        return F.when(text.rlike(r"(?i)^GEOMETRYCOLLECTION\s*\("), F.split(plain, r",\s*(?=[A-Za-z])")).otherwise(F.array(text))

    # Brackets of collections that ended are in surplus; a member's own are in pairs.
    closed = lambda t: F.substring(t, F.lit(1), F.length(t) - F.greatest(F.lit(0), F.regexp_count(t, F.lit(r"\)")) - F.regexp_count(t, F.lit(r"\("))))
    found = F.flatten(F.transform(_let(_body(wkt), members), lambda t: _of_one(_let(F.trim(t), closed))))
    number = lambda r: F.forall(r, lambda x: x["lon"].isNotNull() & x["lat"].isNotNull())
    closed_ring = lambda r: (F.size(r) >= 4) & (F.try_element_at(r, F.lit(1)) == F.try_element_at(r, F.lit(-1)))
    fine = lambda f: F.forall(f, lambda p: F.forall(p["rings"], lambda r: number(r) & F.when(p["dim"] == 2, closed_ring(r)).when(p["dim"] == 1, F.size(r) >= 2).otherwise(True)))
    return _let(found, lambda f: F.when(fine(f), f))


def _sum(wkt: Column | str, of) -> Column:
    return total(F.transform(parts(wkt), of))


def metric_area(wkt: Column | str) -> Column:
    """Square metres on the sphere: outer rings less holes, over all parts; 0 for points and lines."""
    return _sum(wkt, lambda p: F.when(p["dim"] == 2, ring_area(p["rings"][0]) - total(F.transform(F.slice(p["rings"], 2, F.greatest(F.size(p["rings"]) - 1, F.lit(0))), ring_area))).otherwise(0.0))


def metric_length(wkt: Column | str) -> Column:
    """Metres of lines, and of all rings of polygons; 0 for points."""
    return _sum(wkt, lambda p: F.when(p["dim"] > 0, total(F.transform(p["rings"], line_length))).otherwise(0.0))


def dimension(wkt: Column | str) -> Column:
    """The greatest of the parts' dimensions; null without parts."""
    return F.array_max(F.transform(parts(wkt), lambda p: p["dim"]))


def centroid(wkt: Column | str) -> Column:
    """The point (lon, lat) of the parts of the greatest dimension: weighted by area (holes count against), by length, or the mean; null without parts.

    Areas and lines without extent count as lines and as points.
    """
    cross = lambda s: s["a"]["lon"] * s["b"]["lat"] - s["b"]["lon"] * s["a"]["lat"]
    flat = lambda s: F.hypot(s["b"]["lon"] - s["a"]["lon"], s["b"]["lat"] - s["a"]["lat"])
    middle = lambda s, f: (s["a"][f] + s["b"][f]) / 2
    weights = F.struct(*[F.lit(0.0).alias(n) for n in ("w", "x", "y")])
    merge = lambda a, b: F.struct(*[(a[n] + b[n]).alias(n) for n in ("w", "x", "y")])

    def ring(r: Column, sign: Column) -> Column:
        """Area and first moments about the ring's first point, which keeps digits."""
        at = r[0]
        moved = F.transform(r, lambda q: point(q["lon"] - at["lon"], q["lat"] - at["lat"]))
        m = lambda s, f: total(F.transform(s, lambda x: (x["a"][f] + x["b"][f]) * cross(x))) / 6

        def moments(x: Column) -> Column:
            turn = F.signum(x["w"]) * sign
            return F.struct((x["w"] * turn).alias("w"), *[(turn * (x[n] + x["w"] * at[f])).alias(n) for n, f in (("x", "lon"), ("y", "lat"))])

        sums = lambda s: F.struct((total(F.transform(s, cross)) / 2).alias("w"), m(s, "lon").alias("x"), m(s, "lat").alias("y"))
        return _let(_let(_let(moved, steps), sums), moments)

    def line(r: Column) -> Column:
        return _let(steps(r), lambda s: F.struct(total(F.transform(s, flat)).alias("w"), total(F.transform(s, lambda x: middle(x, "lon") * flat(x))).alias("x"), total(F.transform(s, lambda x: middle(x, "lat") * flat(x))).alias("y")))

    def dots(r: Column) -> Column:
        return F.struct(F.size(r).cast("double").alias("w"), total(F.transform(r, lambda q: q["lon"])).alias("x"), total(F.transform(r, lambda q: q["lat"])).alias("y"))

    of = lambda p, d: F.flatten(F.transform(F.filter(p, lambda q: q["dim"] == d), lambda q: F.transform(q["rings"], lambda r, i: F.struct(r.alias("r"), F.when(i == 0, 1.0).otherwise(-1.0).alias("sign")))))
    add = lambda rings, make: F.aggregate(F.transform(rings, make), weights, merge)
    mean = lambda s, other: _let(s, lambda w: F.when(w["w"] > 0, point(w["x"] / w["w"], w["y"] / w["w"])).otherwise(other))

    def found(p: Column) -> Column:
        rings = F.flatten(F.transform(p, lambda q: q["rings"]))
        lines = F.flatten(F.transform(F.filter(p, lambda q: q["dim"] >= 1), lambda q: q["rings"]))
        return mean(add(of(p, 2), lambda x: ring(x["r"], x["sign"])), mean(add(lines, line), mean(add(rings, dots), F.lit(None))))

    return _let(parts(wkt), found)


def centroid_wkt(wkt: Column | str) -> Column:
    return _let(centroid(wkt), lambda c: F.concat(F.lit("POINT("), c["lon"].cast("string"), F.lit(" "), c["lat"].cast("string"), F.lit(")")))


def metric_distance(a: Column | str, b: Column | str) -> Column:
    """Great-circle metres between two points, or between the centroids of what aren't points."""
    return _let(F.struct(centroid(a).alias("x"), centroid(b).alias("y")), lambda c: haversine(c["x"]["lat"], c["x"]["lon"], c["y"]["lat"], c["y"]["lon"]))


def geojson(wkt: Column | str) -> Column:
    """A GeoJSON geometry; null where there are no parts."""
    shape = lambda name, c: F.to_json(F.struct(F.lit(name).alias("type"), c.alias("coordinates")))
    dot = lambda q: F.array(q["rings"][0][0]["lon"], q["rings"][0][0]["lat"])
    polygon = lambda q: F.transform(q["rings"], _pairs)
    made = {"POINT": ("Point", dot), "LINESTRING": ("LineString", lambda q: _pairs(q["rings"][0])), "POLYGON": ("Polygon", polygon)}
    single = lambda q: F.when(q["dim"] == 0, shape("Point", dot(q))).when(q["dim"] == 1, shape("LineString", _pairs(q["rings"][0]))).otherwise(shape("Polygon", polygon(q)))

    def found(x: Column) -> Column:
        k, p = x["kind"], x["parts"]
        out = F.concat(F.lit('{"type":"GeometryCollection","geometries":['), F.array_join(F.transform(p, single), ","), F.lit("]}"))
        for name, (title, make) in made.items():
            out = F.when(k == name, single(p[0])).when(k == f"MULTI{name}", shape(f"Multi{title}", F.transform(p, make))).otherwise(out)
        return F.when(F.size(p) > 0, out)

    return _let(F.struct(kind(wkt).alias("kind"), parts(wkt).alias("parts")), found)


def box_wkt(west: Column, south: Column, east: Column, north: Column) -> Column:
    """A box as a polygon, from its south-western corner to the east."""
    corner = lambda x, y: F.concat(x.cast("string"), F.lit(" "), y.cast("string"))
    return F.concat(F.lit("POLYGON(("), F.concat_ws(", ", corner(west, south), corner(east, south), corner(east, north), corner(west, north), corner(west, south)), F.lit("))"))
