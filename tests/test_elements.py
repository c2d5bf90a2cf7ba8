import pytest
from pyspark.sql import functions as F

from quadrille.functions import text, tiles
from quadrille.operators import assemble, closure, select, spatial_join, tags
from quadrille.plans import catalogue
from quadrille.sources import elements
from quadrille.sources.elements import Elements


@pytest.fixture(scope="module")
def e(spark):
    """Four nodes, a closed and a broken way, and relations in a cycle."""
    make = spark.createDataFrame
    points = [(1, 1.0, 1.0), (2, 2.0, 1.0), (3, 2.0, 2.0), (4, 9.0, 9.0)]
    return Elements(
        nodes=make([(i, int(y * 1e7), int(x * 1e7), y, x) for i, x, y in points], "id long, lat7 long, lon7 long, lat double, lon double"),
        node_tags=make([(4, 0, "place", "city"), (4, 1, "place", "town"), (1, 0, "Name", "x"), (2, 0, "name:en", "y")], "id long, seq int, k string, v string"),
        ways=make([(10,), (11,)], "id long").withColumn("ts", F.current_timestamp()),
        way_tags=make([(10, 0, "building", "yes")], "id long, seq int, k string, v string"),
        way_nodes=make([(10, 0, 1), (10, 1, 2), (10, 2, 3), (10, 3, 1), (11, 0, 1), (11, 1, 99)], "way_id long, seq long, node_id long"),
        relations=make([(42,), (43,), (44,)], "id long"),
        relation_tags=make([(42, 0, "type", "multipolygon"), (43, 0, "type", "route")], "id long, seq int, k string, v string"),
        relation_members=make(
            [(42, 0, "way", 10, "outer"), (42, 1, "node", 4, "label"), (42, 2, "relation", 43, "subarea"), (42, 3, "relation", 42, ""), (43, 0, "relation", 42, ""), (43, 1, "way", 10, ""), (43, 2, "node", 4, ""), (44, 0, "way", 77, "")],
            "rel_id long, seq long, type string, ref long, role string",
        ),
        changesets=make([(1, "x")], "id long, comment string"),
    )


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_geometry(e):
    shapes = {r.id: r for r in assemble.relation_geometries(e).collect()}
    assert shapes[42].kind == "Polygon" and [(p.lon, p.lat) for p in shapes[42].outers[0]] == [(1, 1), (2, 1), (2, 2), (1, 1)]
    assert shapes[43].kind == "LineString" and [(p.lon, p.lat) for p in shapes[43].pts] == [(1, 1), (2, 1), (2, 2), (1, 1), (9, 9)]
    assert 44 not in shapes
    lines = {r.id: len(r.pts) for r in assemble.way_lines(e).collect()}
    assert lines == {10: 4, 11: 1}  # an unknown node is left out


def test_closure_ends_in_cycles(e, spark):
    start = spark.createDataFrame([("relation", 42)], "type string, id long")
    every = [("node", i) for i in (1, 2, 3, 4)] + [("relation", 42), ("relation", 43), ("way", 10)]
    assert rows(closure.recurse_down(e, start)) == sorted(every)
    assert rows(closure.recurse_down(e, start, 0)) == [("relation", 42)]
    full = rows(closure.relation_full(e, e.relations.where("id = 42")))
    assert full == sorted((42, t, i) for t, i in every if (t, i) != ("relation", 42))


def test_completeness(e):
    bad = closure.incomplete_ways(e, e.nodes)
    assert rows(bad) == [(11,)]
    assert rows(closure.incomplete_relations(e, e.nodes, bad)) == [(44,)]
    assert rows(closure.incomplete_relations(e, e.nodes.where("id <> 4"), bad)) == [(42,), (43,), (44,)]
    assert rows(closure.way_full(e, e.ways)) == [(10, 1), (10, 2), (10, 3)]


def test_selection(e):
    assert rows(select.nodes_in(e, (1.5, 0.5, 2.5, 1.5)).select("id")) == [(2,)]
    assert rows(select.ways_in(e, (1.5, 0.5, 2.5, 1.5)).select("id")) == [(10,)]
    assert rows(select.relations_in(e, (8, 8, 10, 10)).select("id")) == [(42,), (43,)]
    assert rows(select.around(e, 1.0, 1.0, 112_000).select("id")) == [(1,), (2,)]
    tag = lambda t: rows(e.node_tags.where(select.tag_condition(t)).select("id", "v"))
    assert tag("place = town") == [(4, "town")] and tag("place") == [(4, "city"), (4, "town")] and len(tag("")) == 4
    assert select.all_elements(e, "way").count() == 2 and select.all_elements(e, "nr").count() == 7
    with pytest.raises(ValueError):
        select.all_elements(e, "area")
    with pytest.raises(ValueError):
        select.parse_bbox("1,2,3")


def test_tag_functions(e):
    assert rows(tags.key_index(select.all_tags(e)).select("k")) == [("building",), ("place",), ("type",)]
    lists = e.node_tags.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("seq", "k", "v"))).alias("t"))
    assert rows(lists.where("id = 4").select(text.first_value(F.col("t"), "place"), text.first_value(F.col("t"), "none")))[0] == ("city", None)


def test_text_functions(spark):
    df = spark.createDataFrame([("Q42", "de:A B", "a b*~/ü", 494574744), ("q42", "Paris", "", -1270000)], "w string, p string, t string, n long")
    got = df.select(text.wikidata_url(F.col("w")), text.wikipedia_url(F.col("p")), text.percent_encoded(F.col("t")), text.fixed7(F.col("n"))).collect()
    assert tuple(got[0]) == ("https://www.wikidata.org/wiki/Q42", "https://de.wikipedia.org/wiki/A_B", "a%20b%2A~%2F%C3%BC", "49.4574744")
    assert tuple(got[1]) == (None, None, "", "-0.1270000")


def test_tiles(spark):
    z = F.lit(0)
    row = spark.range(1).select(tiles.tile_bbox(z, F.lit(0), F.lit(0)).alias("b"), tiles.ground_resolution(F.lit(4), F.lit(0)).alias("north"), tiles.ground_resolution(F.lit(4), F.lit(8)).alias("middle"), tiles.in_range(F.lit(2), F.lit(4), F.lit(0)).alias("out")).first()
    assert (row.b.west, row.b.east) == (-180, 180) and 85 < row.b.north < 86 and row.north < row.middle and not row.out


def test_points_in_areas(spark):
    ring = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0), (0.0, 0.0)]
    areas = spark.createDataFrame([(1, ring)], "id long, pts array<struct<lon:double,lat:double>>")
    points = spark.createDataFrame([(1, 1.0, 1.0), (2, 3.0, 1.0), (3, 0.1, 1.9)], "id long, lon double, lat double")
    for cell in (0.3, 1.0, 10.0):
        assert rows(spatial_join.points_in_areas(points, areas, cell)) == [(1, 1), (3, 1)]


def test_tasks_are_bounded_where_the_session_does_not_say(spark):
    key, given = "spark.sql.adaptive.advisoryPartitionSizeInBytes", spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes", None)
    try:
        spark.conf.unset(key)
        Elements.from_tables(spark, "/root/testdata/sf0.001")
        assert spark.conf.get(key) == "16m"
        spark.conf.set(key, "8m")
        Elements.from_tables(spark, "/root/testdata/sf0.001")
        assert spark.conf.get(key) == "8m"
    finally:
        spark.conf.unset(key) if given is None else spark.conf.set(key, given)


def test_references_are_read_once_for_whole_ways(e):
    found = closure.way_full(e, e.ways)
    assert rows(found) == [(10, 1), (10, 2), (10, 3)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 2


def test_more_input_makes_more_partitions_where_the_session_does_not_say(spark):
    number, least = (f"spark.sql.adaptive.coalescePartitions.{n}" for n in ("initialPartitionNum", "minPartitionNum"))
    given = {k: spark.conf.get(k, None) for k in (number, least)}
    try:
        elements.bound_tasks(spark, 600 * elements.TASK_INPUT)
        assert (spark.conf.get(number), spark.conf.get(least)) == ("600", "600")
        elements.bound_tasks(spark, 1)  # other tables in the same session
        assert (spark.conf.get(number), spark.conf.get(least)) == ("4", "4")
        spark.conf.set(number, "7")
        elements.bound_tasks(spark, 600 * elements.TASK_INPUT)
        assert spark.conf.get(number) == "7"
    finally:
        for k, v in given.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_areas_only(e, spark):
    """The areas among all shapes, without a join for node members; an area whose ways make no ring is a line and isn't among them."""
    more = Elements(**{**e.__dict__, "relation_tags": e.relation_tags.union(spark.createDataFrame([(45, 0, "type", "boundary")], e.relation_tags.schema)), "relation_members": e.relation_members.union(spark.createDataFrame([(45, 0, "way", 11, "outer"), (45, 1, "node", 4, "label")], e.relation_members.schema))})
    shapes = {r.id: r for r in assemble.relation_geometries(more).collect()}
    assert shapes[45].kind == "LineString" and [(p.lon, p.lat) for p in shapes[45].pts] == [(1, 1), (9, 9)] and not shapes[45].outers
    assert {r.id: r for r in assemble.relation_geometries(more, areas_only=True).collect()} == {42: shapes[42]}


def test_rings_of_many_relations_keep_apart():
    rings = [[[(0.0, 1.0), (2.0, 3.0)], [(4.0, 5.0)]], [], [[(6.0, 7.0)]]]
    found = assemble._ring_lists(rings).to_pylist()
    assert [[[(p["lon"], p["lat"]) for p in ring] for ring in r] for r in found] == rings
    assert assemble._ring_lists([[], []]).to_pylist() == [[], []]


def test_turtle_blocks_has_ways(e):
    """A block for each node, way and relation; of the ways both have a type and an identifier, one a tag and its concept."""
    got = {r[0]: r[1:] for r in (tuple(r) for r in catalogue.turtle_blocks(e).collect())}
    assert len(got) == 4 + 2 + 3
    assert got["/osm/way/10#id"] == (4, 4) and got["/osm/way/11#id"] == (2, 2)
