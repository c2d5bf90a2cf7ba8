import json
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from quadrille.functions import text
from quadrille.operators import features, rdf
from quadrille.sources import ntriples, xml

DOCUMENT = """<?xml version="1.0"?>
<osm version="0.6"><note>The data is free.</note>
 <node id="1" lat="1.5" lon="2.5"><tag k="wikidata" v="Q42"/><tag k="wikipedia" v="de:Ein Ort"/><tag k="name" v="a &quot;b&quot;"/></node>
 <way id="10"><nd ref="1" lat="0" lon="0"/><nd lon="1" ref="2" lat="0"/><nd ref="3" lat="1" lon="1"/><nd ref="1" lat="0" lon="0"/><tag k="building" v="yes"/></way>
 <way id="11"><nd ref="1" lat="0" lon="0"/><nd ref="2" lat="0" lon="1"/></way>
 <way id="12"><nd ref="1" lat="0" lon="0"/></way>
 <relation id="20"><member type="way" ref="1" role="outer"><nd lat="0" lon="0"/><nd lat="0" lon="4"/><nd lat="4" lon="4"/></member><member type="way" ref="2" role="outer"><nd lat="0" lon="0"/><nd lat="4" lon="4"/></member>
  <member type="way" ref="3" role="inner"><nd lat="1" lon="2"/><nd lat="1" lon="3"/><nd lat="2" lon="3"/><nd lat="1" lon="2"/></member><member type="way" ref="4" role="label"><nd lat="9" lon="9"/><nd lat="8" lon="8"/></member><tag k="type" v="multipolygon"/></relation>
 <relation id="21"><member type="way" ref="3" role="inner"><nd lat="1" lon="1"/><nd lat="1" lon="2"/></member><member type="way" ref="4" role=""><nd lat="9" lon="9"/><nd lat="8" lon="8"/></member><member type="node" ref="5" role="stop"/></relation>
 <relation id="22"><member type="node" ref="5" role=""/></relation>
</osm>"""


def test_documents_with_their_own_coordinates(spark, tmp_path):
    (tmp_path / "d.xml").write_text(DOCUMENT)
    path = str(tmp_path / "d.xml")
    rows = features.document_features(xml.nodes(spark, path), xml.ways(spark, path), xml.relations(spark, path)).collect()
    got = {(r.type, r.id): json.loads(r.value) for r in rows}
    assert set(got) == {("node", 1), ("way", 10), ("way", 11), ("way", 12), ("relation", 20), ("relation", 21), ("relation", 22)}
    node = got["node", 1]
    assert node["geometry"] == {"type": "Point", "coordinates": [2.5, 1.5]} and "id" not in node
    assert node["properties"] == {"osm_type": "node", "osm_id": "1", "/tag/wikidata": "https://www.wikidata.org/wiki/Q42", "/tag/wikipedia": "https://de.wikipedia.org/wiki/Ein_Ort", "/tag/name": 'a "b"'}
    assert got["way", 10]["geometry"]["type"] == "Polygon" and got["way", 11]["geometry"] == {"type": "LineString", "coordinates": [[0, 0], [1, 0]]} and got["way", 12]["geometry"] is None
    area = got["relation", 20]["geometry"]
    assert area["type"] == "Polygon" and len(area["coordinates"]) == 2 and area["coordinates"][1] == [[2, 1], [3, 1], [3, 2], [2, 1]]
    assert got["relation", 21]["geometry"] == {"type": "MultiLineString", "coordinates": [[[9, 9], [8, 8]], [[1, 1], [2, 1]]]}
    assert got["relation", 22]["geometry"] is None


@pytest.fixture(scope="module")
def run(spark):
    return lambda *columns: tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def test_texts(run):
    lit = F.lit
    assert run(*[text.property_value(lit(k), lit(v)) for k, v in (("wikidata", "Q1"), ("wikidata", "x"), ("wikipedia", "plain"), ("wikipedia", "en:A B:C"), ("name", "Q1"))]) == ("https://www.wikidata.org/wiki/Q1", "x", "plain", "https://en.wikipedia.org/wiki/A_B:C", "Q1")
    assert [tuple(x) for x in run(*[text.wikipedia_triples(lit(v)) for v in ("de:Ein Ort", "en:A b", "Paris x")])] == [("http://de.wikipedia.org/wiki/Ein%20Ort", "http://de.dbpedia.org/resource/Ein%20Ort"), ("http://en.wikipedia.org/wiki/A%20b", "http://dbpedia.org/resource/A%20b"), (None, "http://dbpedia.org/resource/Paris%20x")]
    assert run(text.wiki_page_url(lit("Key:a & b")), text.definition(lit(""), lit("item")), text.definition(lit("page"), lit("item")), text.definition(lit(""), lit(""))) == ("https://wiki.openstreetmap.org/wiki/Key:a_&amp;_b", "item", "page", None)
    assert run(text.redacted(lit("http://x/KEY/y"), "KEY"), text.redacted(lit("http://x/KEY/y"), None)) == ("http://x/redacted/y", "http://x/KEY/y")
    assert run(*[text.element_id(lit(v)) for v in ("12", "0", "-5", "x1", "1.5", "99999999999999999999", "")]) == (12, None, None, None, None, None, None)
    assert run(*[features.role_kind(lit(v)) for v in ("outer", "inner", "Outer", "", "label")]) == ("outer", "inner", "other", "other", "other")


def test_escapes_and_graphs(spark):
    lines = [r'<a> <p> "café \U0001F600\\u0041\n" <g> .', r'<a> <p> _:b _:g .', "<a> <p> <b> ."]
    got = {tuple(r) for r in ntriples.parse(spark.createDataFrame([(x,) for x in lines], "value string"), graphs=True).select("g", "s", "p", "o").collect()}
    assert got == {("g", "a", "p", "café 😀\\u0041\n"), ("_:g", "a", "p", "_:b"), (None, "a", "p", "b")}


def test_descriptions(spark):
    doc = [("/d/1", "https://up/1", datetime(2024, 1, 2, 3, 4, 5, tzinfo=timezone.utc), 11.0, 49.0, 11.5, 49.5), ("/d/2", "https://up/2", None, None, None, None, None)]
    t = rdf.document_triples(spark.createDataFrame(doc, "url string, source string, generated timestamp, west double, south double, east double, north double"), "/index#us")
    rows = {(r.s, r.p): (r.o, r.o_kind, r.o_datatype) for r in t.collect()}
    assert rows["/d/1", "prov:generatedAtTime"] == ("2024-01-02T03:04:05Z", "literal", "xsd:dateTime") and rows["/d/2", "prov:hadPrimarySource"] == ("https://up/2", "iri", None)
    place = rows["/d/1", "dcterms:spatial"][0]
    assert rows[place, "dcat:bbox"] == ("POLYGON((11.0 49.0, 11.5 49.0, 11.5 49.5, 11.0 49.5, 11.0 49.0))", "literal", "gsp:wktLiteral") and ("/d/2", "dcterms:spatial") not in rows
    v = rdf.version_triples(spark.createDataFrame([("node", 5, 3, 7), ("way", 6, None, 8)], "type string, id long, version int, changeset long"))
    assert {tuple(r)[:3] for r in v.collect()} == {("https://api.openstreetmap.org/api/0.6/node/5/3", "prov:value", "3"), ("https://api.openstreetmap.org/api/0.6/node/5/3", "prov:wasGeneratedBy", "/changeset/7")}
    p = rdf.place_triples(spark.createDataFrame([("node", 5, "N", "place", "city", 11.5, 49.5)], "type string, id long, name string, class string, kind string, lon double, lat double"))
    assert {("/osm/node/5#id", "rdfs:label", "N"), ("/osm/node/5#id", "dc:subject", "/tag/place=city#concept"), ("/osm/node/5#id", "geo:lat", "49.5")} <= {tuple(r)[:3] for r in p.collect()}
    tile = rdf.tile_triples(spark.createDataFrame([(1, 0, 0)], "z int, x long, y long"), "plain", "https://up", ["https://free"])
    got = {(r.s, r.p): r.o for r in tile.collect()}
    assert got["/tile/plain/1/0/0", "dcterms:title"] == "plain tile 1/0/0" and got["_:tile-1-0-0", "dcat:bbox"].startswith("POLYGON((-180.0 0.0, 0.0 0.0, 0.0 85.05") and float(got["/tile/plain/1/0/0", "dcat:spatialResolutionInMeters"]) > 50_000
