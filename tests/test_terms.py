import json
import math
import re

import pytest
from pyspark.sql import functions as F

from quadrille.functions import geof, terms
from quadrille.operators import rdf_text


@pytest.fixture(scope="module")
def run(spark):
    def run(*columns):
        return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())

    return run


def test_wkt_parts(spark):
    texts = {
        "POINT(1 2)": (0, 1), "point ( 1.5   -2e1 )": (0, 1), "<http://crs> POINT(1 2)": (0, 1), "LINESTRING(0 0,1 1, 2 0)": (1, 1), "POLYGON((0 0,4 0,4 4,0 4,0 0),(1 1,2 1,2 2,1 1))": (2, 1), "MULTIPOINT(1 1, 2 2)": (0, 2),
        "MULTIPOINT((1 1),(2 2))": (0, 2), "MULTILINESTRING((0 0,1 0),(0 1,1 1))": (1, 2), "MULTIPOLYGON(((0 0,1 0,1 1,0 0)),((5 5,6 5,6 6,5 5),(5.5 5.1,5.6 5.1,5.6 5.2,5.5 5.1)))": (2, 2), "GEOMETRYCOLLECTION(POINT(1 1),POLYGON((0 0,1 0,1 1,0 0)))": (2, 2),
        "GEOMETRYCOLLECTION(LINESTRING(0 0,1 1), GEOMETRYCOLLECTION(POINT(1 1), POINT(2 2)))": (1, 3), "POLYGON EMPTY": (None, 0), "nothing": (None, None), "POINT(a b)": (None, None), "LINESTRING(1 1)": (None, None), "POLYGON((0 0,1 1,0 0))": (None, None), "POLYGON((0 0,1 0,1 1,0 1))": (None, None), None: (None, None), "": (None, None),
    }
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", geof.dimension("t").alias("d"), F.when(geof.parts("t").isNotNull(), F.size(geof.parts("t"))).alias("n")).collect()
    assert {r.t: (r.d, r.n) for r in rows} == texts


def test_measures_of_wkt(spark, run):
    box = "POLYGON((0 0,2 0,2 2,0 2,0 0),(0.5 0.5,1.5 0.5,1.5 1.5,0.5 1.5,0.5 0.5))"
    twice = "MULTIPOLYGON(((0 0,2 0,2 2,0 2,0 0),(0.5 0.5,1.5 0.5,1.5 1.5,0.5 1.5,0.5 0.5)),((10 0,12 0,12 2,10 2,10 0)))"
    area, both, outer, none, point = run(*[geof.metric_area(F.lit(t)) for t in (box, twice, "POLYGON((0 0,2 0,2 2,0 2,0 0))", "POLYGON EMPTY", "POINT(1 1)")])
    assert math.isclose(both, area + outer) and area < outer and none == point == 0.0
    assert run(geof.metric_area(F.lit("POLYGON((0 0,1 1))")), geof.metric_length(F.lit("x"))) == (None, None)
    length, lines = run(geof.metric_length(F.lit("LINESTRING(0 0,0 1)")), geof.metric_length(F.lit("MULTILINESTRING((0 0,0 1),(5 0,5 1))")))
    assert math.isclose(length, 111195.08, rel_tol=1e-6) and math.isclose(lines, 2 * length)
    around = run(geof.metric_length(F.lit(box)), geof.metric_length(F.lit("GEOMETRYCOLLECTION(POINT(1 1),LINESTRING(0 0,0 1))")))
    assert around[0] > 8 * length and math.isclose(around[1], length)
    (c,) = run(geof.centroid(F.lit(twice)))
    assert math.isclose(c.lon, (1 * 3 + 11 * 4) / 7) and math.isclose(c.lat, 1.0)
    assert run(geof.centroid_wkt(F.lit("GEOMETRYCOLLECTION(POINT(9 9),LINESTRING(0 0,4 0))"))) == ("POINT(2.0 0.0)",)
    assert run(geof.centroid_wkt(F.lit("MULTIPOINT(1 1,3 5)")), geof.centroid_wkt(F.lit("POLYGON EMPTY"))) == ("POINT(2.0 3.0)", None)
    (d,) = run(geof.metric_distance(F.lit("POINT(0 0)"), F.lit("LINESTRING(-1 1,1 1)")))
    assert math.isclose(d, length)


def test_geojson_of_wkt(run):
    read = lambda t: json.loads(x) if (x := run(geof.geojson(F.lit(t)))[0]) else x
    assert read("POINT(1 2)") == {"type": "Point", "coordinates": [1, 2]}
    assert read("MULTIPOLYGON(((0 0,1 0,1 1,0 0)),((5 5,6 5,6 6,5 5)))") == {"type": "MultiPolygon", "coordinates": [[[[0, 0], [1, 0], [1, 1], [0, 0]]], [[[5, 5], [6, 5], [6, 6], [5, 5]]]]}
    assert read("MULTILINESTRING((0 0,1 0),(0 1,1 1))") == {"type": "MultiLineString", "coordinates": [[[0, 0], [1, 0]], [[0, 1], [1, 1]]]}
    assert read("GEOMETRYCOLLECTION(POINT(1 1),LINESTRING(0 0,1 1))") == {"type": "GeometryCollection", "geometries": [{"type": "Point", "coordinates": [1, 1]}, {"type": "LineString", "coordinates": [[0, 0], [1, 1]]}]}
    assert read("broken") is None
    assert run(geof.box_wkt(*[F.lit(x) for x in (1.0, 2.0, 3.0, 4.0)])) == ("POLYGON((1.0 2.0, 3.0 2.0, 3.0 4.0, 1.0 4.0, 1.0 2.0))",)


L, T = terms.literal, terms


def test_term_functions(run):
    num, word, plain, iri, node = L("12.5", "xsd:decimal"), L("wort", lang="DE-at"), L("x"), T.iri("http://a"), T.blank("_:b")
    assert run(T.is_iri(iri), T.is_blank(node), T.is_literal(plain), T.is_numeric(num), T.is_numeric(plain), T.is_numeric(L("abc", "xsd:integer")), T.is_numeric(iri)) == (True, True, True, True, False, False, False)
    assert run(T.str_of(iri), T.str_of(node), T.lang(word), T.lang(plain), T.lang(iri), T.datatype(word), T.datatype(plain), T.datatype(num)) == ("http://a", None, "de-at", "", None, "rdf:langString", "xsd:string", "xsd:decimal")
    assert run(T.lang_matches(T.lang(word), "de"), T.lang_matches(T.lang(word), "DE-AT"), T.lang_matches(T.lang(word), "d"), T.lang_matches(T.lang(word), "*"), T.lang_matches(T.lang(plain), "*")) == (True, True, False, True, False)
    assert run(T.same_term(plain, L("x", "xsd:string")), T.same_term(L("1", "xsd:integer"), L("01", "xsd:integer")), T.same_term(word, L("wort"))) == (True, False, False)
    assert run(T.rounded(F.lit(-2.5)), T.rounded(F.lit(2.5)), T.arithmetic(F.lit(1.0), "/", F.lit(0.0)), T.number(L("INF", "xsd:double"))) == (-2.0, 3.0, None, math.inf)
    assert run(T.before(F.lit("abcabc"), "c"), T.before(F.lit("abc"), "x"), T.before(F.lit("abc"), ""), T.after(F.lit("abcabc"), "bc"), T.after(F.lit("abc"), "x"), T.after(F.lit("abc"), "")) == ("ab", "", "", "abc", "", "abc")
    assert run(*[T.hashed(F.lit("abc"), n) for n in ("MD5", "SHA1", "SHA256")]) == ("900150983cd24fb0d6963f7d28e17f72", "a9993e364706816aba3e25717850c26c9cd0d89d", "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad")
    assert run(T.regex(F.lit("Alice"), "^ali", "i"), T.regex(F.lit("Alice"), "^ali")) == (True, False)


def test_times(run):
    t, bare = L("2011-01-10T14:45:13.815-05:00", "xsd:dateTime"), L("2011-01-10T14:45:13", "xsd:dateTime")
    got = run(T.year(t), T.month(t), T.day(t), T.hours(t), T.minutes(t), T.tz(t), T.timezone(t), T.tz(bare), T.timezone(bare), T.timezone(L("2011-01-10T14:45:13Z", "xsd:dateTime")), T.timezone(L("2011-01-10T14:45:13+05:30", "xsd:dateTime")), T.year(L("2011-01-10", "xsd:date")))
    assert got == (2011, 1, 10, 14, 45, "-05:00", "-PT5H", "", None, "PT0S", "PT5H30M", None)
    assert str(run(T.seconds(t))[0]) == "13.815000"
    assert run(T.instant(t) > T.instant(bare)) == (True,)


def test_casts(run):
    value = lambda t, to: (x := run(T.cast(t, to))[0]) and (x.value, x.datatype)
    assert value(L("3.7", "xsd:decimal"), "xsd:integer") == ("3", "xsd:integer") and value(L("-3.7", "xsd:double"), "xsd:integer") == ("-3", "xsd:integer")
    assert value(L("12"), "xsd:integer") == ("12", "xsd:integer") and value(L("1.5"), "xsd:integer") is None and value(T.iri("x"), "xsd:integer") is None
    assert value(L("true", "xsd:boolean"), "xsd:integer") == ("1", "xsd:integer")
    assert value(L("0", "xsd:integer"), "xsd:boolean") == ("false", "xsd:boolean") and value(L("yes"), "xsd:boolean") is None and value(L("1"), "xsd:boolean") == ("true", "xsd:boolean")
    assert value(L("1.50"), "xsd:decimal") == ("1.5", "xsd:decimal") and value(L("20", "xsd:integer"), "xsd:decimal") == ("20", "xsd:decimal")
    assert value(L("1e3"), "xsd:double") == ("1000.0", "xsd:double") and value(L("x"), "xsd:double") is None
    assert value(T.iri("http://a"), "xsd:string") == ("http://a", "xsd:string")
    assert value(L("2020-01-01T00:00:00Z"), "xsd:dateTime") == ("2020-01-01T00:00:00Z", "xsd:dateTime") and value(L("2020"), "xsd:dateTime") is None


def test_order_of_terms(spark):
    rows = [None, ("_:a", "blank", None, None), ("_:b", "blank", None, None), ("http://a", "iri", None, None), ("http://b", "iri", None, None), ("-1", "literal", "xsd:integer", None), ("2.5", "literal", "xsd:decimal", None), ("9", "literal", "xsd:integer", None), ("1e1", "literal", "xsd:double", None)]
    rows += [("2020-01-01T01:00:00+02:00", "literal", "xsd:dateTime", None), ("2020-01-01T00:00:00Z", "literal", "xsd:dateTime", None), ("10", "literal", None, None), ("9", "literal", None, None), ("z", "literal", None, "de"), ("z", "literal", None, "en"), ("a", "literal", "x:y", None)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], f"i int, t {terms.TERM}").repartition(3)
    assert [r.i for r in df.orderBy(*terms.order(F.col("t"))).collect()] == list(range(len(rows)))
    assert [r.i for r in df.orderBy(*terms.order(F.col("t"), descending=True)).collect()] == list(range(len(rows)))[::-1]


# Documents ---------------------------------------------------------------------

TRIPLES = [
    ("/osm/node/1#id", "rdf:type", "osm:Node", "iri", None), ("/osm/node/1#id", "rdf:type", "spatial:Feature", "iri", None), ("/osm/node/1#id", "/tag/name", 'Caf\\"é"\n;\t, x', "literal", None), ("/osm/node/1#id", "geo:lat", "1.5", "literal", "xsd:decimal"),
    ("/osm/node/1#id", "dc:subject", "/tag/a=b c#concept", "iri", None), ("/osm/node/1#id", "/tag/odd key", "v", "literal", None), ("/changeset/1", "prov:wasAssociatedWith", "_:agent1", "blank", None), ("_:agent1", "foaf:accountName", "u, v ;", "literal", None), ("_:agent1", "rdf:type", "prov:Agent", "iri", None),
]
SCHEMA = "s string, p string, o string, o_kind string, o_datatype string"
TOKEN = re.compile(r'\s*(?:(@prefix)\s+(\S+)\s+<([^>]*)>\s*\.|(<[^>]*>|_:\w+|"(?:[^"\\]|\\.)*"(?:\^\^\S+)?|[A-Za-z]+:[\w-]+|a(?=\s))|([;,.]))')


def parsed(text):
    """Triples of the writer's own form of Turtle, with whole addresses."""
    names, out, at, state = {}, set(), 0, []
    full = lambda t: f"<{names[t.split(':')[0] + ':']}{t.split(':', 1)[1]}>" if re.match(r"[A-Za-z]+:", t) else t
    while at < len(text.rstrip()):
        m = TOKEN.match(text, at)
        assert m, text[at : at + 50]
        at = m.end()
        if m[1]:
            names[m[2]] = m[3]
        elif m[4]:
            state.append("<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>" if m[4] == "a" else full(m[4]))
            if len(state) == 3:
                out.add(tuple(state))
                state = state[:2]
        else:
            state = {",": state[:2], ";": state[:1], ".": []}[m[5]]
    return out


def test_turtle_reads_back(spark, tmp_path):
    from quadrille.operators.rdf import ntriples

    t = spark.createDataFrame(TRIPLES * 2, SCHEMA).repartition(3)
    rdf_text.write_turtle(t, f"file://{tmp_path}/t", "http://h")
    text = "".join(f.read_text() for f in sorted((tmp_path / "t").glob("part*"), reverse=True))
    got = parsed(text)
    assert len(got) == len(TRIPLES)
    lines = {r.value for r in ntriples(spark.createDataFrame(TRIPLES, SCHEMA).where("o_kind <> 'blank' AND s NOT LIKE '\\\\_:%'"), "http://h").collect()}
    line = lambda x: x.replace("^^xsd:decimal", "^^<http://www.w3.org/2001/XMLSchema#decimal>")
    assert {" ".join(map(line, x)) + " ." for x in got if "_:agent1" not in x} == lines
    assert ("_:agent1", "<http://xmlns.com/foaf/0.1/accountName>", '"u, v ;"') in got
    blocks = {r.s: r.value for r in rdf_text.turtle(t, "http://h").collect()}
    assert blocks["_:agent1"] == '_:agent1 a prov:Agent ;\n    foaf:accountName "u, v ;" .\n' and blocks["/osm/node/1#id"].startswith("<http://h/osm/node/1#id> a osm:Node, spatial:Feature ;\n")


def test_geojson_of_triples(spark):
    rows = [("/a", "/tag/name", 'N "1"\n', "literal", None), ("/a", "locn:geometry", "<crs> POINT(1 2)", "literal", "gsp:wktLiteral"), ("/a", "dc:subject", "/t1", "iri", None), ("/a", "dc:subject", "/t2", "iri", None)]
    rows += [("/b", "prov:agent", "_:1", "blank", None), ("/c", "locn:geometry", "broken", "literal", "gsp:wktLiteral"), ("/d", "x:y", "_:none", "blank", None), ("_:lonely", "x:y", "z", "literal", None)]
    rows += [(f"_:{i}", "x:next", f"_:{i + 1}", "blank", None) for i in range(1, 9)] + [("_:1", "x:name", "one", "literal", None), ("/e", "x:y", "_:loop", "blank", None), ("_:loop", "x:y", "_:loop", "blank", None)]
    got = {r.s: json.loads(r.value) for r in rdf_text.geojson_of_triples(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()}
    assert set(got) == {"/a", "/b", "/c", "/d", "/e"}
    assert got["/a"] == {"type": "Feature", "id": "/a", "geometry": {"type": "Point", "coordinates": [1, 2]}, "properties": {"/tag/name": 'N "1"\n', "dc:subject": "/t2"}}
    assert got["/c"] == {"type": "Feature", "id": "/c", "geometry": None, "properties": {}} and got["/d"]["properties"] == {"x:y": {}}
    inner, depth = got["/b"]["properties"]["prov:agent"], 0
    assert inner["x:name"] == "one"
    while isinstance(inner, dict):
        inner, depth = inner["x:next"], depth + 1
    assert inner == "[...]" and depth == rdf_text.DEPTH + 1
    assert str(got["/e"]).count("x:y") == rdf_text.DEPTH + 2


def test_collections(spark, tmp_path):
    df = spark.createDataFrame([(f'{{"type":"Feature","id":{i}}}',) for i in range(7)], "value string").coalesce(1)
    rdf_text.write_collection(df, f"file://{tmp_path}/c", "© us")
    (file,) = (tmp_path / "c").glob("part*")
    read = json.loads(file.read_text())
    assert read["attribution"] == "© us" and [f["id"] for f in read["features"]] == list(range(7)) and sorted(read) == ["attribution", "features", "type"]


def test_texts_are_taken_apart_once(spark):
    """No step of reading a text stands in the plan again for each use of its result."""
    plan = spark.createDataFrame([("POINT(1 2)",)], "wkt string").select(geof.centroid("wkt").alias("c"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_count") <= 2 and plan.count("[^(]*") == 1
