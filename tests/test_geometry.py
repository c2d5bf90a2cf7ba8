import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quadrille.functions import geo
from quadrille.operators.assemble import stitch

LINE = "array<struct<lon:double,lat:double>>"
SQUARE = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0), (0.0, 0.0)]
HOLE = [(0.25, 0.25), (0.75, 0.25), (0.75, 0.75), (0.25, 0.75), (0.25, 0.25)]
FAR = [(2.0, 2.0), (3.0, 2.0), (3.0, 3.0), (2.0, 3.0), (2.0, 2.0)]
ROWS = [
    (0, "Empty", [], [], []), (1, "Point", [(11.0741441, 49.4574744)], [], []), (2, "LineString", [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0)], [], []),
    (3, "Polygon", [], [[(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 1.0)]], []), (4, "MultiPolygon", [], [SQUARE, FAR], [HOLE]),
]


@pytest.fixture(scope="module")
def shapes(spark):
    return spark.createDataFrame(ROWS, f"id int, kind string, pts {LINE}, outers array<{LINE}>, inners array<{LINE}>")


def forms(shapes, f):
    c = [F.col(x) for x in ("kind", "pts", "outers", "inners")]
    return [r.v for r in shapes.orderBy("id").select(f(*c).alias("v")).collect()]


def test_wkt(shapes):
    assert forms(shapes, geo.wkt)[:4] == ["GEOMETRYCOLLECTION()", "POINT(11.0741441 49.4574744)", "LINESTRING(1.0 1.0,2.0 1.0,2.0 2.0)", "POLYGON((1.0 1.0,2.0 1.0,2.0 2.0,1.0 1.0))"]
    ring = lambda r: "(" + ",".join(f"{x} {y}" for x, y in r) + ")"
    assert forms(shapes, geo.wkt)[4] == f"MULTIPOLYGON(({ring(SQUARE)},{ring(HOLE)}),({ring(FAR)}))"


def test_geojson(shapes):
    got = forms(shapes, geo.geojson)
    assert got[0] == '{"type":"GeometryCollection","geometries":[]}' and got[1] == '{"type":"Point","coordinates":[11.0741441,49.4574744]}'
    assert got[3] == '{"type":"Polygon","coordinates":[[[1.0,1.0],[2.0,1.0],[2.0,2.0],[1.0,1.0]]]}'
    assert got[4].count("[[[") == 2


def test_xml_forms(shapes):
    gml, kml = forms(shapes, geo.gml), forms(shapes, geo.kml)
    assert gml[0] is None and kml[0] is None and "<gml:pos>11.0741441 49.4574744</gml:pos>" in gml[1]
    assert kml[1] == "<Point><coordinates>11.0741441,49.4574744,0</coordinates></Point>"
    assert gml[4].count("gml:interior>") == 2 and kml[4].count("<innerBoundaryIs>") == 2


def measure(spark, pts, f):
    return spark.createDataFrame([(pts,)], f"pts {LINE}").select(f("pts").alias("v")).first().v


def test_kinds(spark):
    triangle = [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 1.0)]
    for pts, kind in (([], "Empty"), (triangle[:1], "Point"), (triangle[:3], "LineString"), (triangle, "Polygon"), ([triangle[0], triangle[1], triangle[0]], "LineString")):
        assert measure(spark, pts, geo.line_kind) == kind


def test_measures(spark):
    assert measure(spark, SQUARE, geo.signed_area) == -1.0
    assert measure(spark, [(0.0, 0.0), (1.0, 0.0)], geo.line_length) == pytest.approx(geo.EARTH_RADIUS * math.pi / 180)
    assert measure(spark, SQUARE, geo.ring_area) == pytest.approx(12364e6, rel=1e-3)
    assert measure(spark, SQUARE[:3], geo.ring_area) == 0.0
    assert measure(spark, [], geo.line_length) == 0.0 and measure(spark, SQUARE[:1], geo.line_length) == 0.0
    c = measure(spark, SQUARE, geo.planar_centroid)
    assert (c.lon, c.lat) == (0.5, 0.5)
    c = measure(spark, [(0.0, 0.0), (2.0, 0.0), (2.0, 1.0)], geo.planar_centroid)
    assert (c.lon, c.lat) == (pytest.approx(4 / 3), pytest.approx(1 / 6))
    for x, inside in ((0.5, True), (1.5, False), (-0.5, False)):
        assert measure(spark, SQUARE, lambda p, x=x: geo.in_ring(F.lit(x), F.lit(0.5), p)) is inside


def test_stitching_cases():
    a, b, c, d = (0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)
    assert stitch([SQUARE]) == [SQUARE]
    assert stitch([[a, b], [c, b], [c, d], [a, d]]) == [[a, b, c, d, a]]
    assert stitch([SQUARE, FAR]) == [SQUARE, FAR]
    assert stitch([[a, b, c]]) == [[a, b, c, a]]  # closed where that gives four points
    assert stitch([[a, b]]) == []
    assert stitch([[b, c], [a, b]]) == []  # a ring grows at its end only
    assert stitch([[a, b], [b, c], [b, d], [c, a]]) == [[a, b, c, a]]  # the first that fits
    assert stitch([]) == []


@settings(max_examples=100, deadline=None)
@given(st.integers(3, 12), st.integers(1, 6), st.randoms())
def test_a_cut_ring_is_found_again(n, parts, r):
    r = random.Random(r.random())
    ring = [(float(i), float(i * i)) for i in range(n)]
    cuts = sorted(r.sample(range(1, n), min(parts, n - 1)))
    whole = [*ring, ring[0]]
    edges = [0, *cuts, n]
    segments = [whole[a : z + 1] for a, z in zip(edges, edges[1:])]
    segments = [segments[0]] + r.sample(segments[1:], len(segments) - 1)
    segments = [segments[0]] + [s[::-1] if r.random() < 0.5 else s for s in segments[1:]]
    (got,) = stitch(segments)
    assert got[0] == got[-1] and sorted(got[:-1]) == ring
