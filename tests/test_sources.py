import struct
import zlib

import numpy as np
import pytest

from quadrille.sources import pbf, xml

DOCUMENT = """<?xml version="1.0"?>
<osm version="0.6">
 <way id="10" version="3" changeset="7" user="u &amp; v" uid="5" timestamp="2020-01-02T03:04:05Z"><nd ref="1"/><nd ref="2"/><nd ref="3"/><nd ref="1"/><tag k="building" v="yes"/></way>
 <node id="1" lat="1" lon="1"/><node id="2" lat="1.0000001" lon="2"><tag k="a" v="1"/><tag k="a" v="2"/></node><node id="3" lat="2" lon="2" version="21"/><node id="5"/>
 <relation id="42"><member type="way" ref="10" role="outer"/><member type="node" ref="4" role="label"/><tag k="type" v="multipolygon"/></relation>
</osm>"""


def test_xml_document(spark, tmp_path):
    (tmp_path / "d.xml").write_text(DOCUMENT)
    path = str(tmp_path / "d.xml")
    nodes = {r.id: r for r in xml.nodes(spark, path).collect()}
    assert set(nodes) == {1, 2, 3} and nodes[2].lat7 == 10000001 and nodes[3].version == 21
    assert [(t.k, t.v) for t in nodes[2].tags] == [("a", "1"), ("a", "2")] and nodes[1].tags == []
    way = xml.ways(spark, path).first()
    assert way.refs == [1, 2, 3, 1] and way.user == "u & v" and way.tags[0].k == "building"
    assert [tuple(r) for r in xml.way_nodes(xml.ways(spark, path)).orderBy("seq").collect()] == [(10, 0, 1), (10, 1, 2), (10, 2, 3), (10, 3, 1)]
    members = [tuple(r) for r in xml.relation_members(xml.relations(spark, path)).orderBy("seq").collect()]
    assert members == [(42, 0, "way", 10, "outer"), (42, 1, "node", 4, "label")]
    assert [tuple(r) for r in xml.tags(xml.relations(spark, path)).collect()] == [(42, 0, "type", "multipolygon")]


def test_xml_places_and_changesets(spark, tmp_path):
    (tmp_path / "p.xml").write_text('<searchresults><place lat="1.5" lon="2.5" osm_type="node" osm_id="9" display_name="N" class="c" type="t" importance="0.5"/><place osm_id="8"/></searchresults>')
    (tmp_path / "c.xml").write_text('<osm><changeset id="3" created_at="2020-01-01T00:00:00Z" user="u" uid="4" changes_count="6"><tag k="comment" v="x"/></changeset></osm>')
    assert [tuple(r) for r in xml.places(spark, str(tmp_path / "p.xml")).collect()] == [("node", 9, "N", "c", "t", 0.5, 2.5, 1.5)]
    c = xml.changesets(spark, str(tmp_path / "c.xml")).first()
    assert (c.id, c.user, c.changes, c.bounds, c.tags[0].v) == (3, "u", 6, None, "x")


# A small encoder of block files, for tests only.
def varint(n):
    n &= (1 << 64) - 1
    out = b""
    while True:
        out += bytes([n & 127 | (128 if n > 127 else 0)])
        n >>= 7
        if not n:
            return out


def field(number, value):
    if isinstance(value, bytes):
        return varint(number << 3 | 2) + varint(len(value)) + value
    return varint(number << 3) + varint(value)


def zig(n):
    return n << 1 ^ n >> 63


def deltas(values):
    return b"".join(varint(zig(b - a)) for a, b in zip([0, *values], values))


def blob(kind, data, compress):
    body = field(3, zlib.compress(data)) + field(2, len(data)) if compress else field(1, data)
    head = field(1, kind.encode()) + field(3, len(body))
    return struct.pack(">I", len(head)) + head + body


STRINGS = field(1, b"".join(field(1, s) for s in (b"", b"name", b"caf\xc3\xa9", b"outer")))


def block(granularity=100, lat_offset=0):
    dense = field(1, deltas([10, 12, 9])) + field(8, deltas([494574744, -5, 7])) + field(9, deltas([1, 2, 3])) + field(10, b"".join(map(varint, [1, 2, 0, 0, 1, 3, 1, 2, 0])))
    dense += field(5, field(1, b"".join(map(varint, [4, 5, 6]))) + field(2, deltas([1000, 2000, 0])))
    plain = field(1, zig(77)) + field(8, zig(100)) + field(9, zig(-100)) + field(2, varint(1)) + field(3, varint(2))
    way = field(1, 500) + field(2, 1) + field(3, 2) + field(8, deltas([10, 12, 9, 10])) + field(4, field(1, 3))
    relation = field(1, 900) + field(8, varint(3) + varint(0)) + field(9, deltas([500, 10])) + field(10, varint(1) + varint(0))
    groups = field(2, field(2, dense)) + field(2, field(1, plain)) + field(2, field(3, way)) + field(2, field(4, relation))
    return STRINGS + groups + field(17, granularity) + field(19, lat_offset)


HEADER = field(4, b"OsmSchema-V0.6") + field(4, b"DenseNodes")


def test_block_file(spark, tmp_path):
    data = blob("OSMHeader", HEADER, True) + blob("OSMData", block(), True) + blob("Other", b"skipped", False) + blob("OSMData", block(1000, 50), False)
    (tmp_path / "f.pbf").write_bytes(data)
    rows = pbf.read(spark, str(tmp_path)).collect()
    assert len(rows) == 12
    nodes = {r.id: r for r in rows if r.type == "node" and r.lat7 in (494574744, -5, 7, 100)}
    assert (nodes[10].lat7, nodes[12].lat7, nodes[77].lon7) == (494574744, -5, -100)
    assert [(t.k, t.v) for t in nodes[10].tags] == [("name", "café")] and nodes[12].tags == [] and nodes[9].version == 6 and nodes[9].ts is None
    assert nodes[10].refs is None and nodes[10].members is None
    way = next(r for r in rows if r.type == "way")
    assert way.refs == [10, 12, 9, 10] and way.version == 3 and way.lats7 == [] and way.members is None
    relation = next(r for r in rows if r.type == "relation")
    assert [tuple(m) for m in relation.members] == [("way", 500, "outer"), ("node", 10, "")]


def located(lats, lons, id=1):
    way = field(1, id) + field(8, deltas(range(1, len(lats) + 1))) + field(9, deltas(lats)) + field(10, deltas(lons))
    return STRINGS + field(2, field(3, way))


def test_locations_on_ways(spark, tmp_path):
    ways = [located([494574744, 1, -5], [1, 2, 3], 1), located([1, 2147483647], [1, 2147483647], 2), located([1, 2, 3], [1, 2], 3), located([], [], 4)]
    (tmp_path / "f.pbf").write_bytes(blob("OSMHeader", STRICT, True) + b"".join(blob("OSMData", w, True) for w in ways))
    got = {r.id: r for r in pbf.read(spark, str(tmp_path), strict=True).withColumn("fine", pbf.has_locations()).collect()}
    assert got[1].lats7 == [494574744, 1, -5] and got[1].lons7 == [1, 2, 3] and got[1].refs == [1, 2, 3]
    assert [got[i].fine for i in (1, 2, 3, 4)] == [True, False, False, False]


STRICT = field(4, b"OsmSchema-V0.6") + field(4, b"DenseNodes") + field(5, b"Sort.Type_then_ID") + field(5, b"LocationsOnWays") + field(32, 1700000000) + field(33, 4321) + field(34, b"https://example.org/diffs")


def test_headers(spark, tmp_path):
    (tmp_path / "strict.pbf").write_bytes(blob("OSMHeader", STRICT, True) + blob("OSMData", block(), True))
    got = pbf.headers(spark, str(tmp_path)).collect()
    assert [(r.required, r.optional, r.replication_timestamp.timestamp(), r.replication_sequence, r.replication_url) for r in got] == [(["OsmSchema-V0.6", "DenseNodes"], ["Sort.Type_then_ID", "LocationsOnWays"], 1700000000, 4321, "https://example.org/diffs")]
    plain = tmp_path / "plain"
    plain.mkdir()
    (plain / "f.pbf").write_bytes(blob("OSMHeader", HEADER, False) + blob("OSMData", block(), True))
    assert pbf.read(spark, str(plain)).count() == 6
    assert pbf.headers(spark, str(plain)).select("replication_sequence", "replication_timestamp").first() == (None, None)
    with pytest.raises(Exception, match="the file lacks"):
        pbf.read(spark, str(plain), strict=True).count()


def test_a_file_is_read_by_many_tasks(spark, tmp_path):
    """Splits cut through blobs; every element is read once, in order, by several tasks."""
    blocks = [STRINGS + field(2, field(2, field(1, deltas(range(i * 100, i * 100 + 100))) + field(8, deltas([i] * 100)) + field(9, deltas([7] * 100)))) for i in range(60)]
    data = blob("OSMHeader", STRICT, True) + b"".join(blob("OSMData", b, i % 3 == 0) for i, b in enumerate(blocks))
    (tmp_path / "f.pbf").write_bytes(data)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in (len(data) // 7, 997, 100):
            for k in before:
                spark.conf.set(k, size if "max" in k else 1)
            df = pbf.read(spark, str(tmp_path / "f.pbf"), strict=True)
            assert df.rdd.getNumPartitions() >= 7
            assert sorted((r.id, r.lat7) for r in df.collect()) == [(i, i // 100) for i in range(6000)]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_the_separator_inside_of_a_blob(spark, tmp_path):
    """A raw blob whose strings hold the bytes at which files are cut is put together again."""
    strings = field(1, b"".join(field(1, s) for s in (b"", b"k", b"x" + pbf.SEPARATOR.encode() + pbf.SEPARATOR.encode() + b"y")))
    node = field(1, zig(5)) + field(8, zig(1)) + field(9, zig(2)) + field(2, varint(1)) + field(3, varint(2))
    data = blob("OSMHeader", HEADER, False) + blob("OSMData", strings + field(2, field(1, node)), False) + blob("OSMData", block(), True)
    (tmp_path / "f.pbf").write_bytes(data)
    rows = pbf.read(spark, str(tmp_path)).collect()
    assert len(rows) == 7 and [t.v for r in rows if r.id == 5 for t in r.tags] == [f"x{pbf.SEPARATOR}{pbf.SEPARATOR}y"]


@pytest.mark.parametrize("data", ["cut", "headless", "empty block", "long", "codec"])
def test_broken_files_are_refused(spark, tmp_path, data):
    whole = blob("OSMHeader", HEADER, True) + blob("OSMData", block(), True)
    text = {
        "cut": whole[:-3],
        "headless": blob("OSMData", block(), True),
        "empty block": whole + blob("OSMData", b"", True)[:-9],
        "long": blob("OSMHeader", HEADER, True) + struct.pack(">I", 12) + field(1, b"OSMData") + field(3, 40 << 20),
        "codec": blob("OSMHeader", HEADER, True) + struct.pack(">I", 11) + field(1, b"OSMData") + field(3, 4) + field(7, b"zz"),
    }[data]
    (tmp_path / "f.pbf").write_bytes(text)
    with pytest.raises(Exception, match="ValueError|BrokenOff|KeyError"):
        pbf.read(spark, str(tmp_path)).count()


def test_dense_tags():
    words = lambda *x: np.array(x, np.int64)
    sizes, keys, values = pbf.dense_tags(words(1, 2, 3, 0, 0, 5, 6, 0), 3)
    assert (sizes.tolist(), keys.tolist(), values.tolist()) == ([2, 1, 0], [1, 3, 5], [2, 0, 6])
    assert pbf.dense_tags(words(), 2)[0].tolist() == [0, 0]
    for broken in (words(1), words(1, 2, 0, 3), words(0, 0, 1, 2)):
        with pytest.raises(ValueError):
            pbf.dense_tags(broken, 2)


def test_numbers():
    values = [0, 1, -1, 2**40, -(2**62), 127, 128]
    assert pbf.varints(b"".join(map(varint, values))).tolist() == values
    assert pbf.zigzag(np.array([0, 1, 2, 3, -1])).tolist() == [0, -1, 1, -2, -(2**63)]
    with pytest.raises(ValueError):
        pbf.varints(b"\x80")
    with pytest.raises(ValueError):
        list(pbf.fields(b"\x0a\x05ab"))
    with pytest.raises(ValueError):
        pbf.check_header(field(1, field(4, b"HistoricalInformation")))


def test_ntriples_and_statistics(spark):
    from quadrille.sources import ntriples, statistics

    lines = ['<a> <p> "x\\"y\\\\n\\n"@en .', "<a> <p> <b> . # c", "_:n <p> \"1\"^^<int> .", "", "# comment", "broken", "<a> <p> <b> ."]
    got = sorted(tuple(r) for r in ntriples.parse(spark.createDataFrame([(x,) for x in lines], "value string")).collect())
    assert got == sorted([("a", "p", 'x"y\\n\n', "literal", None, "en"), ("a", "p", "b", "iri", None, None), ("_:n", "p", "1", "literal", "int", None)])
    one = lambda x: spark.createDataFrame([(x,)], "value string")
    assert [tuple(r) for r in statistics.overview(one('{"data":[{"type":"all","count":5},{"type":"ways","count":0}]}')).collect()] == [("all", 5)]
    items = '{"search":[{"id":"Q1","label":"amenity x","description":"no"},{"id":"Q2","label":"amenity","description":""}]}'
    assert [tuple(r) for r in statistics.definition(one(items), "amenity").collect()] == [("Q2", None)]
    assert statistics.definition(one(items), "shop").count() == 0
