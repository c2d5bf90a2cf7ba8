import json
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from quadrille.functions import terms
from quadrille.operators import features, solutions
from quadrille.sources import registry

T = terms


@pytest.fixture(scope="module")
def found(spark):
    rows = [("http://a?x=1&y=2", "iri", None, None, 1), ("_:b", "blank", None, None, 2), ('t "q"\t<>', "literal", None, "de", 3), ("5", "literal", "xsd:integer", None, 4), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "value string, kind string, datatype string, lang string, n int").coalesce(1)
    return df.select(F.when(F.col("kind").isNotNull(), F.struct("value", "kind", "datatype", "lang")).alias("t"), "n")


def text(path):
    (file,) = path.glob("part*")
    return file.read_text()


def test_json(found, tmp_path):
    solutions.write(found, f"file://{tmp_path}/r", "json")
    got = json.loads(text(tmp_path / "r"))
    assert got["head"] == {"vars": ["t", "n"]}
    t = [b.get("t") for b in got["results"]["bindings"]]
    assert t == [{"type": "uri", "value": "http://a?x=1&y=2"}, {"type": "bnode", "value": "b"}, {"type": "literal", "value": 't "q"\t<>', "xml:lang": "de"}, {"type": "literal", "value": "5", "datatype": "xsd:integer"}, None]
    assert got["results"]["bindings"][0]["n"] == {"type": "literal", "value": "1"} and got["results"]["bindings"][4] == {}
    solutions.write(found.limit(0).coalesce(1), f"file://{tmp_path}/none", "json")
    assert not "".join(f.read_text() for f in (tmp_path / "none").glob("part*"))
    assert json.loads(solutions.ask_json(True)) == {"boolean": True}


def test_xml_and_tsv(found, tmp_path):
    solutions.write(found, f"file://{tmp_path}/x", "xml")
    root = ET.fromstring(text(tmp_path / "x"))
    ns = "{" + solutions.RESULTS_XML + "}"
    assert [v.get("name") for v in root.iter(f"{ns}variable")] == ["t", "n"]
    values = [next((b[0].text for b in r if b.get("name") == "t"), None) for r in root.iter(f"{ns}result")]
    assert values == ["http://a?x=1&y=2", "b", 't "q"\t<>', "5", None]
    solutions.write(found, f"file://{tmp_path}/t", "tsv")
    assert text(tmp_path / "t") == '?t\t?n\n<http://a?x=1&y=2>\t"1"\n_:b\t"2"\n"t \\"q\\"\\t<>"@de\t"3"\n5\t"4"\n\t\n'
    with pytest.raises(ValueError):
        solutions.write(found, f"file://{tmp_path}/q", "csv")


def test_kml_and_gml(spark, tmp_path):
    line = "array<struct<lon:double,lat:double>>"
    p = lambda *xy: [{"lon": float(x), "lat": float(y)} for x, y in xy]
    rows = [(1, "LineString", p((0, 0), (1, 1)), [], []), (2, "Polygon", [], [p((0, 0), (1, 0), (1, 1), (0, 0))], []), (3, "Empty", [], [], [])]
    shapes = spark.createDataFrame(rows, f"id long, kind string, pts {line}, outers array<{line}>, inners array<{line}>").coalesce(1)
    features.write_kml(features.kml_placemarks(shapes, "way").coalesce(1), f"file://{tmp_path}/k")
    root = ET.fromstring(text(tmp_path / "k").split("?>", 1)[1])
    assert [x.text for x in root.iter("{http://www.opengis.net/kml/2.2}name")] == ["way 1", "way 2"]
    assert next(root.iter("{http://www.opengis.net/kml/2.2}coordinates")).text == "0.0,0.0,0 1.0,1.0,0"
    tags = spark.createDataFrame([(1, 0, "name", 'a & "b"'), (1, 1, "x", "y")], "id long, seq int, k string, v string")
    members = spark.createDataFrame([(1, 0, "way", 7, "outer")], "rel_id long, seq long, type string, ref long, role string")
    features.write_gml(features.gml_members(shapes, "relation", tags, members).orderBy("id").coalesce(1), f"file://{tmp_path}/g")
    root = ET.fromstring(text(tmp_path / "g"))
    own = "{https://www.openstreetmap.org/}"
    first, _, empty = [m[0] for m in root]
    assert first.tag == f"{own}relation" and [(t.get("key"), t.get("value")) for t in first.iter(f"{own}tag")] == [("name", 'a & "b"'), ("x", "y")]
    assert [dict(m.attrib) for m in first.iter(f"{own}member")] == [{"type": "way", "ref": "7", "role": "outer"}] and first.find(f"{own}geometry") is not None and len(empty) == 0


def test_registries(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"regions": {"south": {"file": "s.pbf", "source": "https://s", "licence": "ODbL-1.0", "integrated": True}, "north": {"file": "n.pbf"}}}, indent=1))
    assert sorted(map(tuple, registry.regions(spark, f"{tmp_path}/r.json").collect())) == [("north", "n.pbf", None, None, None), ("south", "s.pbf", "https://s", "ODbL-1.0", True)]
    (tmp_path / "e.json").write_text(json.dumps({"examples": [{"source": "s", "name": "one", "query": "q\n1"}, {"source": "s", "name": "two", "query": "q2"}]}))
    assert [(r.at, r.name, r.query) for r in registry.examples(spark, f"{tmp_path}/e.json").orderBy("at").collect()] == [(0, "one", "q\n1"), (1, "two", "q2")]
    (tmp_path / "x.json").write_text("no json")
    assert registry.regions(spark, f"{tmp_path}/x.json").count() == 0


def test_prefixed_names_are_one_lookup(spark):
    """A check for each prefix made the code too large to be compiled, so every row was interpreted."""
    from quadrille.operators import rdf_text

    rows = [("/a", "osm:x", "v", "literal", "osm:t"), ("/a", "nope:x", "geo:1 2", "iri", None), ("_:b", "geo:lat", "foaf:n", "iri", None)]
    blocks = rdf_text.turtle(spark.createDataFrame(rows, "s string, p string, o string, o_kind string, o_datatype string"), "https://e.org")
    assert blocks._jdf.queryExecution().optimizedPlan().toString().count("StartsWith") < 4 * 13
    got = {r.s: r.value for r in blocks.collect()}
    assert got == {"/a": '<https://e.org/a> <nope:x> <http://www.w3.org/2003/01/geo/wgs84_pos#1 2> ;\n    osm:x "v"^^osm:t .\n', "_:b": "_:b geo:lat foaf:n .\n"}
