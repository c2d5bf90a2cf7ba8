"""The registered queries on elements and, where SQL can express them, the same in DuckDB SQL.

Every query runs over its whole tables. A function's name is its query's name.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadrille.functions import geo, geof, terms, text, tiles
from quadrille.operators import assemble, closure, features, rdf, rdf_text, select, spatial_join, tags, topology
from quadrille.plans import graph, paths
from quadrille.sources import store
from quadrille.sources.elements import Elements, projection_ctes
from quadrille.tables import materialize, shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

# What the registered queries ask for.
BBOX = (11.02, 49.4, 11.05, 49.43)
BBOX_SQL = "lon7 BETWEEN 110200000 AND 110500000 AND lat7 BETWEEN 494000000 AND 494300000"
CENTRE, RADIUS = (11.05, 49.402), 1000.0
ABSENT = "(id - 1) % 97 = 0"
BLOCK_ROWS = 1000
LEVEL = 16
R = geo.EARTH_RADIUS


def query(sql: str | None = None, *needs: str):
    """Register a function of Elements; ``sql`` follows the projection of the element tables that it needs."""

    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Elements.from_tables(spark, sf_dir))
        if sql:
            ORACLE_SQL[f.__name__] = (projection_ctes(*needs) + (",\n" if sql.lstrip().startswith(",") else "\n") + sql.strip().lstrip(",")) if needs else sql
        return f

    return register


# Scans -----------------------------------------------------------------------


@query("SELECT id, lat7, lon7, lat, lon FROM nodes", "nodes")
def nodes_scan(e):
    return e.nodes


@query("SELECT * FROM way_nodes", "way_nodes")
def way_nodes_scan(e):
    return e.way_nodes


@query("SELECT * FROM relation_members", "relation_members")
def relation_members_scan(e):
    return e.relation_members


@query("SELECT 'node' AS type, id FROM nodes UNION ALL SELECT 'way', id FROM ways UNION ALL SELECT 'relation', id FROM relations", "nodes", "ways", "relations")
def element_union(e):
    return select.all_elements(e)


@query("SELECT id, min_by(v, seq) AS v FROM (SELECT id, seq, v FROM node_tags WHERE k IN ('name', 'name:en')) GROUP BY id", "node_tags")
def node_tags_first_value(e):
    named = e.node_tags.where(F.col("k").isin("name", "name:en"))
    lists = named.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("seq", "k", "v"))).alias("tags"))
    return lists.select("id", F.coalesce(text.first_value(F.col("tags"), "name"), text.first_value(F.col("tags"), "name:en")).alias("v"))


@query("SELECT id, format('{}.{:07d}', lat7 // 10000000, lat7 % 10000000) AS lat, format('{}.{:07d}', lon7 // 10000000, lon7 % 10000000) AS lon FROM nodes", "nodes")
def coord_seven_decimals(e):
    return e.nodes.select("id", text.fixed7(F.col("lat7")).alias("lat"), text.fixed7(F.col("lon7")).alias("lon"))


@query(", steps AS (SELECT way_id, seq, node_id - lag(node_id, 1, 0) OVER (PARTITION BY way_id ORDER BY seq) AS delta FROM way_nodes) SELECT way_id, seq, CAST(sum(delta) OVER (PARTITION BY way_id ORDER BY seq) AS bigint) AS node_id FROM steps", "way_nodes")
def ids_delta_decode(e):
    at = Window.partitionBy("way_id").orderBy("seq")
    steps = e.way_nodes.select("way_id", "seq", (F.col("node_id") - F.lag("node_id", 1, 0).over(at)).alias("delta"))
    return steps.select("way_id", "seq", F.sum("delta").over(at).alias("node_id"))


# Selections ------------------------------------------------------------------


@query(f"SELECT id FROM nodes WHERE {BBOX_SQL}", "nodes")
def bbox_nodes(e):
    return select.nodes_in(e, BBOX).select("id")


@query(f"SELECT DISTINCT way_id AS id FROM way_nodes JOIN nodes ON node_id = id WHERE {BBOX_SQL}", "nodes", "way_nodes")
def bbox_ways_any_node(e):
    return select.ways_in(e, BBOX).select("id")


SMALL_BOX = (11.0305, 49.4005, 11.0335, 49.4015)


@query(
    """, placed AS (SELECT way_id AS id, seq, lon, lat, lead(lon) OVER w AS lon2, lead(lat) OVER w AS lat2, count(*) OVER (PARTITION BY way_id) AS n FROM way_nodes JOIN nodes ON node_id = nodes.id WINDOW w AS (PARTITION BY way_id ORDER BY seq)),
    strips AS (SELECT id, CASE WHEN lon = lon2 THEN CASE WHEN lon BETWEEN 11.0305 AND 11.0335 THEN 0 ELSE 2 END ELSE least((11.0305 - lon) / (lon2 - lon), (11.0335 - lon) / (lon2 - lon)) END AS x0, CASE WHEN lon = lon2 THEN 1 ELSE greatest((11.0305 - lon) / (lon2 - lon), (11.0335 - lon) / (lon2 - lon)) END AS x1,
        CASE WHEN lat = lat2 THEN CASE WHEN lat BETWEEN 49.4005 AND 49.4015 THEN 0 ELSE 2 END ELSE least((49.4005 - lat) / (lat2 - lat), (49.4015 - lat) / (lat2 - lat)) END AS y0, CASE WHEN lat = lat2 THEN 1 ELSE greatest((49.4005 - lat) / (lat2 - lat), (49.4015 - lat) / (lat2 - lat)) END AS y1 FROM placed WHERE lon2 IS NOT NULL)
    SELECT DISTINCT id FROM strips WHERE greatest(x0, y0, 0) <= least(x1, y1, 1)""",
    "nodes", "way_nodes",
)
def bbox_ways_crossing(e):
    """Ways that cross a box between the grid's points."""
    return assemble.way_lines(e).where(geo.crosses_box("pts", *SMALL_BOX)).select("id")


@query(f"SELECT DISTINCT rel_id AS id FROM relation_members WHERE type = 'way' AND ref IN (SELECT way_id FROM way_nodes JOIN nodes ON node_id = id WHERE {BBOX_SQL})", "nodes", "way_nodes", "relation_members")
def bbox_relations(e):
    return select.relations_in(e, BBOX).select("id")


@query("SELECT DISTINCT id FROM node_tags WHERE k = 'name:en'", "node_tags")
def tag_exists(e):
    return e.node_tags.where(select.tag_condition("name:en")).select("id").distinct()


@query("SELECT DISTINCT id FROM way_tags WHERE k = 'building' AND v = 'yes'", "way_tags")
def tag_equals(e):
    return e.way_tags.where(select.tag_condition("building = yes")).select("id").distinct()


@query("SELECT DISTINCT id FROM node_tags WHERE regexp_matches(k, 'amenity|shop|tourism|leisure|healthcare') AND v <> ''", "node_tags")
def poi_default(e):
    return e.node_tags.where(select.poi_condition()).select("id").distinct()


def _haversine(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    h = f"(sin(radians({lat2} - {lat1}) / 2) * sin(radians({lat2} - {lat1}) / 2) + cos(radians({lat1})) * cos(radians({lat2})) * sin(radians({lon2} - {lon1}) / 2) * sin(radians({lon2} - {lon1}) / 2))"
    return f"2 * {R} * atan2(sqrt({h}), sqrt(1 - {h}))"


@query(f"SELECT id, round(metres, 3) AS metres FROM (SELECT id, {_haversine(str(CENTRE[1]), str(CENTRE[0]), 'lat', 'lon')} AS metres FROM nodes) WHERE metres <= {RADIUS}", "nodes")
def around_nodes(e):
    return select.around(e, *CENTRE, RADIUS).select("id", F.round("metres", 3).alias("metres"))


@query(
    f", found AS (SELECT a.id AS left_id, b.id AS right_id, {_haversine('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS metres FROM nodes a JOIN nodes b ON abs(a.lat7 - b.lat7) < 100000 AND a.id < b.id) SELECT left_id, right_id, round(metres, 3) AS metres FROM found WHERE metres <= 500", "nodes"
)
def around_join(e):
    """All pairs of nodes within 500 m of each other, once each."""
    pairs = select.around_pairs(e.nodes, e.nodes, 500.0).where("left_id < right_id")
    return pairs.select("left_id", "right_id", F.round("metres", 3).alias("metres"))


@query("SELECT way_id AS id, count(*) AS n FROM way_nodes JOIN nodes ON node_id = id GROUP BY way_id HAVING bool_and(lat7 BETWEEN -900000000 AND 900000000 AND lon7 BETWEEN -1800000000 AND 1800000000)", "nodes", "way_nodes")
def valid_coordinates(e):
    fine = F.col("lat7").between(-900000000, 900000000) & F.col("lon7").between(-1800000000, 1800000000)
    placed = e.way_nodes.join(e.nodes.select(F.col("id").alias("node_id"), fine.alias("fine")), "node_id")
    return placed.groupBy(F.col("way_id").alias("id")).agg(F.count("*").alias("n"), F.bool_and("fine").alias("fine")).where("fine").drop("fine")


@query("SELECT 'node' AS type, id FROM nodes WHERE id IN (SELECT id FROM node_tags) UNION ALL SELECT 'way', id FROM ways WHERE id IN (SELECT id FROM way_tags) UNION ALL SELECT 'relation', id FROM relations WHERE id IN (SELECT id FROM relation_tags)", "nodes", "node_tags", "ways", "way_tags", "relations", "relation_tags")
def tagged_only(e):
    return select.all_elements(e).join(select.all_tags(e), ["type", "id"], "left_semi")


@query("SELECT DISTINCT id FROM node_tags WHERE k = 'amenity' ORDER BY id LIMIT 20", "node_tags")
def limit_by_id(e):
    return e.node_tags.where(select.tag_condition("amenity")).select("id").distinct().orderBy("id").limit(20)


def place_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most important places whose names hold all words."""
    places = spark.read.parquet(f"{sf_dir}/customer.parquet").select((F.col("c_custkey") + 1).alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("importance"))
    return select.search(places, "Customer 1", 10)


QUERIES["place_search"] = place_search
ORACLE_SQL["place_search"] = "SELECT c_custkey + 1 AS id, c_name AS name, c_acctbal AS importance FROM customer WHERE contains(lower(c_name), 'customer') AND contains(lower(c_name), '1') ORDER BY importance DESC, id LIMIT 10"


# Closure ---------------------------------------------------------------------


@query("SELECT way_id AS id, count(*) AS n, CAST(sum(seq * lon7) AS bigint) AS lon_check, CAST(sum(seq * lat7) AS bigint) AS lat_check FROM way_nodes JOIN nodes ON node_id = id GROUP BY way_id", "nodes", "way_nodes")
def way_coordinates(e):
    """Ordered coordinates, compared by sums weighted with the position."""
    p = F.posexplode("pts").alias("seq", "p")
    whole = lambda f: F.sum(F.col("seq") * F.round(F.col("p")[f] * 1e7).cast("long"))
    return assemble.way_lines(e).select("id", p).groupBy("id").agg(F.count("*").alias("n"), whole("lon").alias("lon_check"), whole("lat").alias("lat_check"))


@query(f", there AS (SELECT id FROM nodes WHERE NOT ({ABSENT})) SELECT DISTINCT way_id, node_id FROM way_nodes w WHERE NOT EXISTS (SELECT 1 FROM way_nodes x WHERE x.way_id = w.way_id AND x.node_id NOT IN (SELECT id FROM there))", "nodes", "way_nodes")
def way_full(e):
    return closure.way_full(_extract(e), e.ways)


def _extract(e: Elements) -> Elements:
    """The elements without the nodes that lie outside of an extract."""
    return Elements(**{**e.__dict__, "nodes": e.nodes.where(f"NOT ({ABSENT})")})


@query(
    """SELECT DISTINCT rel_id, type, id FROM (
        SELECT rel_id, type, ref AS id FROM relation_members WHERE NOT (type = 'relation' AND ref = rel_id)
        UNION ALL SELECT rel_id, 'node', node_id FROM relation_members JOIN way_nodes ON type = 'way' AND ref = way_id)""",
    "way_nodes", "relation_members",
)
def relation_full_depth1(e):
    return closure.relation_full(e, e.relations)


@query(
    """, start AS (SELECT 'relation' AS type, id FROM relations WHERE id >= 200000000),
    one AS (SELECT type, id FROM start UNION SELECT m.type, m.ref FROM relation_members m JOIN start s ON s.type = 'relation' AND s.id = m.rel_id)
    SELECT type, id FROM one UNION SELECT 'node', node_id FROM way_nodes JOIN one ON one.type = 'way' AND one.id = way_id""",
    "way_nodes", "relations", "relation_members",
)
def recurse_down_1(e):
    return closure.recurse_down(e, e.relations.where("id >= 200000000").select(F.lit("relation").alias("type"), "id"), 1)


@query(
    """, l0 AS (SELECT 'relation' AS type, id FROM relations WHERE id >= 200000000),
    l1 AS (SELECT DISTINCT m.type, m.ref AS id FROM relation_members m JOIN l0 ON l0.type = 'relation' AND l0.id = m.rel_id),
    l2 AS (SELECT DISTINCT m.type, m.ref AS id FROM relation_members m JOIN l1 ON l1.type = 'relation' AND l1.id = m.rel_id),
    l3 AS (SELECT DISTINCT m.type, m.ref AS id FROM relation_members m JOIN l2 ON l2.type = 'relation' AND l2.id = m.rel_id),
    every AS (SELECT * FROM l0 UNION SELECT * FROM l1 UNION SELECT * FROM l2 UNION SELECT * FROM l3)
    SELECT type, id FROM every UNION SELECT 'node', node_id FROM way_nodes JOIN every ON every.type = 'way' AND every.id = way_id""",
    "way_nodes", "relations", "relation_members",
)
def recurse_down_all(e):
    return closure.recurse_down(e, e.relations.where("id >= 200000000").select(F.lit("relation").alias("type"), "id"))


BAD_WAYS = f"SELECT DISTINCT way_id AS id FROM way_nodes WHERE node_id NOT IN (SELECT id FROM nodes WHERE NOT ({ABSENT}))"


@query(BAD_WAYS, "nodes", "way_nodes")
def incomplete_ways(e):
    return closure.incomplete_ways(e, _extract(e).nodes)


BAD_RELATIONS = f", bad AS ({BAD_WAYS}), bad_relations AS (SELECT DISTINCT rel_id AS id FROM relation_members WHERE type = 'way' AND (ref IN (SELECT id FROM bad) OR ref NOT IN (SELECT id FROM ways)) UNION SELECT rel_id FROM relation_members WHERE type = 'relation' AND ref NOT IN (SELECT id FROM relations))"


def _bad_relations(e):
    present = _extract(e).nodes
    return closure.incomplete_relations(e, present, closure.incomplete_ways(e, present))


@query(BAD_RELATIONS + " SELECT id FROM bad_relations", "nodes", "way_nodes", "ways", "relations", "relation_members")
def incomplete_relations(e):
    return _bad_relations(e)


@query(BAD_RELATIONS + " SELECT id FROM relations WHERE id NOT IN (SELECT id FROM bad_relations)", "nodes", "way_nodes", "ways", "relations", "relation_members")
def complete_relations(e):
    return e.relations.join(_bad_relations(e), "id", "left_anti")


@query("SELECT id, CASE WHEN id % 3 = 0 THEN 0 WHEN id % 2 = 0 THEN 1 ELSE 2 END AS region FROM nodes", "nodes")
def region_fallback(e):
    """Three overlapping regions; the first that has a node serves it."""
    return closure.first_region([e.nodes.where("id % 3 = 0"), e.nodes.where("id % 2 = 0"), e.nodes])


INDEX = f"SELECT id // {BLOCK_ROWS} AS block, min(id) AS min_id, max(id) AS max_id, count(*) AS n FROM ways GROUP BY 1"


@query(INDEX, "ways")
def block_index(e):
    return closure.block_index(e.ways, BLOCK_ROWS)


@query(f", idx AS ({INDEX}) SELECT w.id, CASE WHEN w.id BETWEEN min_id AND max_id THEN block END AS block FROM (SELECT id * 3 AS id FROM ways) w LEFT JOIN idx ON w.id // {BLOCK_ROWS} = block", "ways")
def block_lookup(e):
    return closure.block_lookup(closure.block_index(e.ways, BLOCK_ROWS), e.ways.select((F.col("id") * 3).alias("id")), BLOCK_ROWS)


# A way without nodes has no place, so it isn't complete.
PLACELESS = "SELECT id FROM ways WHERE id NOT IN (SELECT way_id FROM way_nodes)"
COMPLETE = f", bad AS ({BAD_WAYS} UNION {PLACELESS}), fine AS (SELECT id FROM relations WHERE id NOT IN (SELECT rel_id FROM relation_members WHERE type = 'way' AND (ref IN (SELECT id FROM bad) OR ref NOT IN (SELECT id FROM ways)) OR type = 'relation' AND ref NOT IN (SELECT id FROM relations)))"


@query(
    COMPLETE
    + """ SELECT 'relation' AS of_type, id AS of_id, 'relation' AS type, id FROM fine UNION SELECT 'relation', rel_id, type, ref FROM relation_members WHERE rel_id IN (SELECT id FROM fine)
    UNION SELECT 'relation', rel_id, 'node', node_id FROM relation_members JOIN way_nodes ON type = 'way' AND ref = way_id WHERE rel_id IN (SELECT id FROM fine)""",
    "nodes", "way_nodes", "ways", "relations", "relation_members",
)
def relation_full_complete(e):
    """All that a relation needs, or nothing where the extract lacks a part of it."""
    return closure.full_complete(_extract(e), e.relations.select(F.lit("relation").alias("type"), "id"))


@query(
    COMPLETE + " SELECT 'way' AS of_type, id AS of_id, 'way' AS type, id FROM ways WHERE id NOT IN (SELECT id FROM bad) UNION SELECT 'way', way_id, 'node', node_id FROM way_nodes WHERE way_id NOT IN (SELECT id FROM bad)",
    "nodes", "way_nodes", "ways", "relations", "relation_members",
)
def way_full_complete(e):
    return closure.full_complete(_extract(e), e.ways.select(F.lit("way").alias("type"), "id"))


#: Three regions as conditions on nodes and ways; each lacks something else.
REGIONS = [(f"NOT ({ABSENT})", "true"), ("(id - 1) % 31 <> 0 OR id > 500", "true"), ("true", "id % 10 <> 0")]
REGION_TABLES = "".join(
    f""", bad_ways_{i} AS (SELECT DISTINCT way_id AS id FROM way_nodes WHERE node_id NOT IN (SELECT id FROM nodes WHERE {n}) UNION SELECT id FROM ways WHERE NOT ({w}) UNION {PLACELESS}),
    fine_{i} AS (SELECT id FROM relations WHERE id NOT IN (SELECT rel_id FROM relation_members WHERE type = 'way' AND ref IN (SELECT id FROM bad_ways_{i})))"""
    for i, (n, w) in enumerate(REGIONS)
)
CHOICE = "CASE " + " ".join(f"WHEN id IN (SELECT id FROM fine_{i}) THEN {i}" for i in range(len(REGIONS))) + " END"


def _regions(e: Elements) -> list[Elements]:
    return [Elements(**{**e.__dict__, "nodes": e.nodes.where(n), "ways": e.ways.where(w)}) for n, w in REGIONS]


@query(REGION_TABLES + f" SELECT 'relation' AS type, id, {CHOICE} AS region FROM relations", "nodes", "way_nodes", "ways", "relations", "relation_members")
def region_complete(e):
    """The first of three regions that holds each relation completely."""
    return closure.first_complete_region(_regions(e), e.relations.select(F.lit("relation").alias("type"), "id"))


@query(
    REGION_TABLES
    + f""", chosen AS (SELECT id AS of_id, {CHOICE} AS region FROM relations), all_of AS (SELECT rel_id AS of_id, type, ref AS id FROM relation_members UNION SELECT rel_id, 'node', node_id FROM relation_members JOIN way_nodes ON type = 'way' AND ref = way_id UNION SELECT id, 'relation', id FROM relations)
    SELECT region, count(*) AS answers, CAST(sum(n) AS bigint) AS elements FROM (SELECT region, of_id, count(*) AS n FROM chosen JOIN all_of USING (of_id) WHERE region IS NOT NULL GROUP BY region, of_id) GROUP BY region""",
    "nodes", "way_nodes", "ways", "relations", "relation_members",
)
def region_fallback_full(e):
    """How many relations each region answers, and with how many elements."""
    full = closure.fallback_full(_regions(e), e.relations.select(F.lit("relation").alias("type"), "id"))
    return full.groupBy("region", "of_id").agg(F.count("*").alias("n")).groupBy("region").agg(F.count("*").alias("answers"), F.sum("n").alias("elements"))


# The element store -------------------------------------------------------------

STORE_ROWS = 700
PLACED = f""", named AS (SELECT 'node' AS type, id FROM nodes UNION ALL SELECT 'way', id FROM ways UNION ALL SELECT 'relation', id FROM relations),
    placed AS (SELECT type, id, (row_number() OVER (ORDER BY CASE type WHEN 'node' THEN 0 WHEN 'way' THEN 1 ELSE 2 END, id) - 1) // {STORE_ROWS} AS block FROM named),
    idx AS (SELECT block, type, min(id) AS first_id, max(id) AS last_id, count(*) AS n FROM placed GROUP BY block, type)"""
NAMED = ("nodes", "ways", "relations")


def _stored(e: Elements, **more) -> store.Store:
    return store.write(select.all_elements(e), f"{shared_folder(e.nodes.sparkSession)}/store-{uuid.uuid4().hex}", block_rows=STORE_ROWS, **more)


@query(PLACED + " SELECT * FROM idx", *NAMED)
def store_index(e):
    """First and last id of each block and type of the elements in order; blocks hold equally many rows, so ids are spread unevenly."""
    return store.block_ranges(store.ordered(select.all_elements(e), STORE_ROWS))


@query(PLACED + " SELECT w.type, w.id, idx.block FROM (SELECT type, id * 3 AS id FROM named) w LEFT JOIN idx ON w.type = idx.type AND w.id BETWEEN first_id AND last_id", *NAMED)
def store_lookup(e):
    """The block that may hold an id, by a search in the index."""
    index = store.block_ranges(store.ordered(select.all_elements(e), STORE_ROWS))
    return store.lookup(index, select.all_elements(e).select("type", (F.col("id") * 3).alias("id")))


@query(PLACED + " SELECT p.type, p.id, p.block FROM placed p JOIN named w ON p.type = w.type AND p.id = w.id * 3 WHERE w.id % 7 = 0 AND w.type <> 'node'", *NAMED)
def store_fetch(e):
    """Elements read back from a written store by their ids, some of which it lacks."""
    wanted = select.all_elements(e, "wr").where("id % 7 = 0").select("type", (F.col("id") * 3).alias("id"))
    return _stored(e).fetch(wanted).select("type", "id", "block")


@query(
    f", bad AS ({BAD_WAYS})" + PLACED + " SELECT 'blocks' AS key, CAST(count(DISTINCT block) AS varchar) AS value FROM placed UNION ALL SELECT type || 's', CAST(count(*) AS varchar) FROM placed GROUP BY type UNION ALL SELECT 'incomplete_ways', CAST(count(*) AS varchar) FROM bad UNION ALL SELECT 'region', 'test'",
    *NAMED, "way_nodes",
)
def store_manifest_written(e):
    """The manifest of a written store, as it is read again."""
    bad = closure.incomplete_ways(e, _extract(e).nodes)
    state = _stored(e, region="test", incomplete={"way": bad}).manifest()
    kept = ("region", "blocks", "nodes", "ways", "relations", "incomplete_ways")
    return e.nodes.sparkSession.createDataFrame([(k, state[k]) for k in kept], "key string, value string")


# Aggregates ------------------------------------------------------------------


@query("SELECT way_id AS id, round(avg(lon), 6) AS lon, round(avg(lat), 6) AS lat FROM (SELECT DISTINCT way_id, node_id FROM way_nodes) JOIN nodes ON node_id = id GROUP BY way_id", "nodes", "way_nodes")
def doc_centroid(e):
    placed = e.way_nodes.select("way_id", "node_id").distinct().join(e.nodes, F.col("node_id") == F.col("id"))
    return placed.groupBy(F.col("way_id").alias("id")).agg(F.round(F.avg("lon"), 6).alias("lon"), F.round(F.avg("lat"), 6).alias("lat"))


LINES = """, placed AS (SELECT way_id AS id, seq, lon, lat, lead(lon) OVER w AS lon2, lead(lat) OVER w AS lat2 FROM way_nodes JOIN nodes ON node_id = nodes.id WINDOW w AS (PARTITION BY way_id ORDER BY seq)),
    ends AS (SELECT id, count(*) AS n, min_by(lon, seq) AS lon_first, min_by(lat, seq) AS lat_first, max_by(lon, seq) AS lon_last, max_by(lat, seq) AS lat_last FROM placed GROUP BY id),
    kinds AS (SELECT id, n, CASE WHEN n = 1 THEN 'Point' WHEN n >= 4 AND abs(lon_first - lon_last) < 1e-9 AND abs(lat_first - lat_last) < 1e-9 THEN 'Polygon' ELSE 'LineString' END AS kind FROM ends)"""
GEO = ("nodes", "way_nodes")


def _kinds(e):
    return assemble.way_lines(e).withColumn("kind", geo.line_kind("pts"))


@query(LINES + " SELECT id, round(avg(lon), 6) AS lon, round(avg(lat), 6) AS lat FROM placed WHERE id IN (SELECT id FROM kinds WHERE kind = 'Polygon') GROUP BY id", *GEO)
def ring_centroid(e):
    mean = geo.mean_point("pts")
    return _kinds(e).where("kind = 'Polygon'").select("id", F.round(mean["lon"], 6).alias("lon"), F.round(mean["lat"], 6).alias("lat"))


TAGS = ", tags AS (SELECT 'node' AS type, * FROM node_tags UNION ALL SELECT 'way', * FROM way_tags UNION ALL SELECT 'relation', * FROM relation_tags)"
TAGGED = ("node_tags", "way_tags", "relation_tags")
USES = "count(*) AS uses, count(*) FILTER (WHERE type = 'node') AS nodes, count(*) FILTER (WHERE type = 'way') AS ways, count(*) FILTER (WHERE type = 'relation') AS relations"


@query(TAGS + f" SELECT k, {USES} FROM tags GROUP BY k", *TAGGED)
def key_counts(e):
    return tags.usage(select.all_tags(e), "k")


@query(TAGS + f" SELECT k, v, {USES} FROM tags GROUP BY k, v", *TAGGED)
def tag_counts(e):
    return tags.usage(select.all_tags(e), "k", "v")


@query(TAGS + " SELECT * FROM (SELECT k, v, uses, row_number() OVER (PARTITION BY k ORDER BY uses DESC, v) AS rank FROM (SELECT k, v, count(*) AS uses FROM tags WHERE v <> '' GROUP BY k, v)) WHERE rank <= 20", *TAGGED)
def top_values_per_key(e):
    return tags.top_values(select.all_tags(e))


@query(TAGS + " SELECT * FROM (SELECT k, count(*) AS uses FROM tags GROUP BY k ORDER BY uses DESC, k LIMIT 200) WHERE regexp_matches(k, '^[^*:+A-Z][^:]*$')", *TAGGED)
def key_index(e):
    return tags.key_index(select.all_tags(e))


@query(TAGS + " SELECT k, count(*) AS uses FROM tags WHERE k LIKE 'name:%' GROUP BY k HAVING count(*) >= 300", *TAGGED)
def namespace_variants(e):
    return tags.namespace_variants(select.all_tags(e), "name", 300)


CONFIRMED = " SELECT v, count(*) AS uses, CAST(v AS integer) % 2 = 0 AS confirmed FROM node_tags WHERE k = 'size' GROUP BY v"


def _documented(e):
    return e.node_tags.where("k = 'size' AND CAST(v AS int) % 2 = 0").select("v").distinct()


@query(CONFIRMED, "node_tags")
def confirmed_values(e):
    return tags.confirmed_values(e.node_tags, _documented(e), "size")


@query(f"SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM ways) AS ways, (SELECT count(*) FROM relations) AS relations, (SELECT count(*) FROM ({BAD_WAYS})) AS incomplete_ways", "nodes", "ways", "way_nodes", "relations")
def store_manifest(e):
    """Counts of all tables in one row: a union of aggregates, summed."""
    zero = {n: F.lit(0).cast("long").alias(n) for n in ("nodes", "ways", "relations", "incomplete_ways")}
    parts = {"nodes": e.nodes, "ways": e.ways, "relations": e.relations, "incomplete_ways": closure.incomplete_ways(e, _extract(e).nodes)}
    rows = [df.agg(F.count("*").alias(n)).select(*[F.col(n) if n == m else z for m, z in zero.items()]) for n, df in parts.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.agg(*[F.sum(n).alias(n) for n in zero])


@query("SELECT count(*) AS violations FROM (SELECT node_id, lag(node_id) OVER (PARTITION BY way_id ORDER BY seq) AS before FROM way_nodes) WHERE before >= node_id", "way_nodes")
def order_violations(e):
    before = F.lag("node_id").over(Window.partitionBy("way_id").orderBy("seq"))
    return e.way_nodes.select("node_id", before.alias("before")).where("before >= node_id").agg(F.count("*").alias("violations"))


@query(TAGS + " SELECT type, k, count(*) AS uses FROM tags GROUP BY CUBE (type, k)", *TAGGED)
def key_type_cube(e):
    return select.all_tags(e).cube("type", "k").agg(F.count("*").alias("uses"))


# Geometry --------------------------------------------------------------------

STEP = _haversine("lat", "lon", "lat2", "lon2")
LENGTH = f"coalesce(sum({STEP}), 0)"
AREA = f"abs(sum((radians(lon2) - radians(lon)) * (sin(radians(lat)) + sin(radians(lat2))))) * {R} * {R} / 2"


@query(LINES + " SELECT id, kind FROM kinds", *GEO)
def geometry_kind(e):
    return _kinds(e).select("id", "kind")


@query(LINES + " SELECT id, round(sum((lon2 - lon) * (lat2 + lat)) / 2, 6) + 0.0 AS area FROM placed JOIN kinds USING (id) WHERE kind = 'Polygon' GROUP BY id", *GEO)
def signed_area(e):
    return _kinds(e).where("kind = 'Polygon'").select("id", (F.round(geo.signed_area("pts"), 6) + F.lit(0.0)).alias("area"))


@query(LINES + f" SELECT id, round({AREA}, 1) AS m2 FROM placed JOIN kinds USING (id) WHERE kind = 'Polygon' GROUP BY id", *GEO)
def metric_area(e):
    return _kinds(e).where("kind = 'Polygon'").select("id", F.round(geo.ring_area("pts"), 1).alias("m2"))


@query(LINES + f" SELECT id, round({LENGTH}, 3) AS metres FROM placed GROUP BY id", *GEO)
def metric_length(e):
    return assemble.way_lines(e).select("id", F.round(geo.line_length("pts"), 3).alias("metres"))


@query(LINES + f" SELECT id, round({LENGTH}, 3) AS metres FROM placed JOIN kinds USING (id) WHERE kind = 'Polygon' GROUP BY id", *GEO)
def perimeter(e):
    return _kinds(e).where("kind = 'Polygon'").select("id", F.round(geo.line_length("pts"), 3).alias("metres"))


@query(LINES + f" SELECT id, round({_haversine('lat_first', 'lon_first', 'lat_last', 'lon_last')}, 3) AS metres FROM ends", *GEO)
def metric_distance(e):
    """From a way's first to its last node."""
    a, z = F.try_element_at("pts", F.lit(1)), F.try_element_at("pts", F.lit(-1))
    return assemble.way_lines(e).select("id", F.round(geo.haversine(a["lat"], a["lon"], z["lat"], z["lon"]), 3).alias("metres"))


@query(
    LINES + """, sums AS (SELECT id, kind, sum(lon * lat2 - lon2 * lat) AS a, sum((lon + lon2) * (lon * lat2 - lon2 * lat)) AS ax, sum((lat + lat2) * (lon * lat2 - lon2 * lat)) AS ay,
        sum(sqrt((lon2 - lon) ** 2 + (lat2 - lat) ** 2)) AS l, sum((lon + lon2) / 2 * sqrt((lon2 - lon) ** 2 + (lat2 - lat) ** 2)) AS lx, sum((lat + lat2) / 2 * sqrt((lon2 - lon) ** 2 + (lat2 - lat) ** 2)) AS ly
        FROM placed JOIN kinds USING (id) GROUP BY id, kind)
    SELECT id, round(lx / l, 6) AS lon, round(ly / l, 6) AS lat FROM sums WHERE kind = 'LineString' AND l > 0""", *GEO
)
def planar_centroid(e):
    c = geo.planar_centroid("pts")
    lines = _kinds(e).where((F.col("kind") == "LineString") & (geo.line_length("pts") > 0))
    return lines.select("id", F.round(c["lon"], 6).alias("lon"), F.round(c["lat"], 6).alias("lat"))


HISTOGRAM = " SELECT CASE kind WHEN 'Point' THEN 0 WHEN 'LineString' THEN 1 ELSE 2 END AS dim, count(*) AS features FROM kinds GROUP BY 1"


@query(LINES + HISTOGRAM, *GEO)
def dimension_histogram(e):
    return _kinds(e).groupBy(geo.dimension("kind").alias("dim")).agg(F.count("*").alias("features"))


@query(LINES + " SELECT id, n FROM kinds WHERE kind = 'Polygon'", *GEO)
def closed_ways(e):
    return assemble.way_lines(e).where(geo.is_closed("pts")).select("id", F.size("pts").cast("long").alias("n"))


@query()
def multipolygon_rings(e):
    """Rings of every area relation; stitching depends on order, so tests hold it against exact cases."""
    return assemble.relation_geometries(e).select("id", "kind", F.size("outers").alias("n_outer"), F.size("inners").alias("n_inner"))


@query()
def multipolygon_area(e):
    return assemble.relation_geometries(e, areas_only=True).select("id", F.round(assemble.geometry_area(), 1).alias("m2"))


@query()
def inner_ring_assignment(e):
    """Rings of each polygon: all holes belong to the first outer ring."""
    areas = assemble.relation_geometries(e, areas_only=True)
    ring = F.posexplode("outers").alias("ring", "pts")
    return areas.select("id", F.size("inners").alias("holes"), ring).select("id", "ring", F.when(F.col("ring") == 0, F.col("holes")).otherwise(0).alias("holes"), F.size("pts").alias("n_points"))


# Topology --------------------------------------------------------------------

BOXES = ", boxes AS (SELECT id, min(lon) AS west, min(lat) AS south, max(lon) AS east, max(lat) AS north FROM placed JOIN kinds USING (id) WHERE kind = 'Polygon' GROUP BY id)"
CELL = 0.01


def _areas(e):
    """All closed ways."""
    return _kinds(e).where("kind = 'Polygon'")


@query(LINES + BOXES + " SELECT nodes.id AS point_id, boxes.id AS box_id FROM nodes JOIN boxes ON lon BETWEEN west AND east AND lat BETWEEN south AND north", *GEO)
def spatial_join_cells(e):
    boxes = _areas(e).select("id", geo.envelope("pts").alias("e")).select("id", "e.*")
    return spatial_join.points_in_boxes(e.nodes.select("id", "lon", "lat"), boxes, CELL)


@query(
    LINES + """ SELECT n.id AS point_id, s.id AS area_id FROM nodes n JOIN placed s ON (s.lat > n.lat) <> (s.lat2 > n.lat) AND n.lon < (s.lon2 - s.lon) * (n.lat - s.lat) / (s.lat2 - s.lat) + s.lon
    WHERE s.id IN (SELECT id FROM kinds WHERE kind = 'Polygon') GROUP BY n.id, s.id HAVING count(*) % 2 = 1""", *GEO
)
def points_in_areas(e):
    return spatial_join.points_in_areas(e.nodes.select("id", "lon", "lat"), _areas(e).select("id", "pts"), CELL)


@query(
    LINES + """, sides AS MATERIALIZED (SELECT id, lon, lat, lon2, lat2 FROM placed WHERE lat <> lat2 AND id IN (SELECT id FROM kinds WHERE kind = 'Polygon')), parts AS MATERIALIZED (SELECT rel_id, ref FROM relation_members WHERE type = 'way'),
    ring_sides AS MATERIALIZED (SELECT rel_id, lon, lat, lon2, lat2 FROM sides JOIN parts ON sides.id = parts.ref)
    SELECT n.id AS point_id, s.rel_id AS area_id FROM nodes n JOIN ring_sides s ON (s.lat > n.lat) <> (s.lat2 > n.lat) AND n.lon < (s.lon2 - s.lon) * (n.lat - s.lat) / (s.lat2 - s.lat) + s.lon
    GROUP BY n.id, s.rel_id HAVING count(*) % 2 = 1""", *GEO, "relation_members"
)
def points_in_multipolygons(e):
    """Nodes inside the closed ways of each relation together, even-odd: of rings that overlap, one is a hole in the other."""
    rings = e.relation_members.where("type = 'way'").join(_areas(e).select(F.col("id").alias("ref"), "pts"), "ref")
    areas = rings.groupBy(F.col("rel_id").alias("id")).agg(F.collect_list("pts").alias("rings"))
    return spatial_join.points_in_areas(e.nodes.select("id", "lon", "lat"), areas, CELL)


GRID = 20_000
#: A square around each node, of one, two or three steps of the grid to each side.
SQUARES = f", boxes AS MATERIALIZED (SELECT id, lon7 - (1 + id % 3) * {GRID} AS w, lat7 - (1 + id % 3) * {GRID} AS s, lon7 + (1 + id % 3) * {GRID} AS e, lat7 + (1 + id % 3) * {GRID} AS n FROM nodes)"


def _squares(e):
    r = (F.lit(1) + F.col("id") % 3) * GRID
    corner = lambda x, y: geo.point((F.col("lon7") + x) / 1e7, (F.col("lat7") + y) / 1e7)
    ring = F.array(corner(-r, -r), corner(r, -r), corner(r, r), corner(-r, r), corner(-r, -r))
    none = F.array().cast("array<array<struct<lon:double,lat:double>>>")
    return e.nodes.select("id", F.lit("Polygon").alias("kind"), F.array().cast("array<struct<lon:double,lat:double>>").alias("pts"), F.array(ring).alias("outers"), none.alias("inners"))


INSIDE = "a.w >= b.w AND a.e <= b.e AND a.s >= b.s AND a.n <= b.n"
AROUND = "b.w >= a.w AND b.e <= a.e AND b.s >= a.s AND b.n <= a.n"
DEEP = "a.w < b.e AND b.w < a.e AND a.s < b.n AND b.s < a.n"


@query(SQUARES + f" SELECT CASE WHEN {INSIDE} AND {AROUND} THEN 'sfEquals' WHEN {INSIDE} THEN 'sfWithin' WHEN {AROUND} THEN 'sfContains' WHEN {DEEP} THEN 'sfOverlaps' ELSE 'sfTouches' END AS relation, a.id AS a_id, b.id AS b_id FROM boxes a JOIN boxes b ON a.w <= b.e AND b.w <= a.e AND a.s <= b.n AND b.s <= a.n", "nodes")
def topology_areas(e):
    """How the squares around all nodes lie to each other."""
    squares = materialize(_squares(e))
    two = F.lit(2)
    kind = F.coalesce(*[F.when(topology.holds(p, a_dim=two, b_dim=two), p) for p in ("sfEquals", "sfWithin", "sfContains", "sfOverlaps", "sfTouches")])
    return topology.relate(squares, squares, CELL).select(kind.alias("relation"), "a_id", "b_id")


TILE_W, TILE_S = 110007123, 494003517
STREETS = f"""{LINES}, tiles AS (SELECT x * 100 + y AS tile, ({TILE_W} + x * 200000) / 1e7 AS t_w, ({TILE_S} + y * 200000) / 1e7 AS t_s, ({TILE_W} + (x + 1) * 200000) / 1e7 AS t_e, ({TILE_S} + (y + 1) * 200000) / 1e7 AS t_n FROM range(5) t(x), range((SELECT max(lat7) - {TILE_S} FROM nodes) // 200000 + 1) u(y)),
    pieces AS (SELECT placed.id, tile, lon BETWEEN t_w AND t_e AND lat BETWEEN t_s AND t_n AS at_a, CASE WHEN lon = lon2 THEN CASE WHEN lon BETWEEN t_w AND t_e THEN 0 ELSE 2 END ELSE least((t_w - lon) / (lon2 - lon), (t_e - lon) / (lon2 - lon)) END AS x0, CASE WHEN lon = lon2 THEN 1 ELSE greatest((t_w - lon) / (lon2 - lon), (t_e - lon) / (lon2 - lon)) END AS x1,
        CASE WHEN lat = lat2 THEN CASE WHEN lat BETWEEN t_s AND t_n THEN 0 ELSE 2 END ELSE least((t_s - lat) / (lat2 - lat), (t_n - lat) / (lat2 - lat)) END AS y0, CASE WHEN lat = lat2 THEN 1 ELSE greatest((t_s - lat) / (lat2 - lat), (t_n - lat) / (lat2 - lat)) END AS y1
        FROM placed JOIN kinds USING (id), tiles WHERE kind = 'LineString')"""


@query(STREETS + " SELECT id AS way_id, tile, CASE WHEN bool_and(at_a) THEN 'sfWithin' ELSE 'sfCrosses' END AS relation FROM pieces GROUP BY id, tile HAVING bool_or(at_a OR (x0 IS NOT NULL AND y0 IS NOT NULL AND greatest(x0, y0, 0) <= least(x1, y1, 1)))", *GEO)
def topology_ways_tiles(e):
    """Open ways that cross a tile of a coarse grid, or lie within it."""
    rows = e.nodes.agg(F.floor((F.max("lat7") - TILE_S) / 200000).alias("last")).select(F.explode(F.sequence(F.lit(0), F.col("last"))).alias("y"))
    grid = rows.select(F.explode(F.sequence(F.lit(0), F.lit(4))).alias("x"), "y")
    corner = lambda i, j: geo.point((F.lit(TILE_W) + (F.col("x") + i) * 200000) / 1e7, (F.lit(TILE_S) + (F.col("y") + j) * 200000) / 1e7)
    none = F.array().cast("array<array<struct<lon:double,lat:double>>>")
    tiles_ = grid.select((F.col("x") * 100 + F.col("y")).alias("id"), F.lit("Polygon").alias("kind"), F.array().cast("array<struct<lon:double,lat:double>>").alias("pts"), F.array(F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1), corner(0, 0))).alias("outers"), none.alias("inners"))
    lines = assemble.way_geometries(e).where("kind = 'LineString'")
    kind = F.when(topology.holds("sfWithin"), "sfWithin").when(topology.holds("sfCrosses", a_dim=F.lit(1), b_dim=F.lit(2)), "sfCrosses").otherwise("sfTouches")
    return topology.relate(materialize(lines), materialize(tiles_), CELL).select(F.col("a_id").alias("way_id"), F.col("b_id").alias("tile"), kind.alias("relation"))


CENTRES = f"""{LINES}, base AS (SELECT id, min_by(lon, seq) AS lon0, min_by(lat, seq) AS lat0 FROM placed GROUP BY id), moved AS (SELECT id, kind, lon0, lat0, lon - lon0 AS x, lat - lat0 AS y, lon2 - lon0 AS x2, lat2 - lat0 AS y2 FROM placed JOIN base USING (id) JOIN kinds USING (id)),
    sums AS (SELECT id, kind, lon0, lat0, sum(x * y2 - x2 * y) AS a, sum((x + x2) * (x * y2 - x2 * y)) AS ax, sum((y + y2) * (x * y2 - x2 * y)) AS ay, sum(sqrt((x2 - x) ** 2 + (y2 - y) ** 2)) AS l, sum((x + x2) / 2 * sqrt((x2 - x) ** 2 + (y2 - y) ** 2)) AS lx, sum((y + y2) / 2 * sqrt((x2 - x) ** 2 + (y2 - y) ** 2)) AS ly FROM moved GROUP BY id, kind, lon0, lat0),
    centres AS (SELECT id, lon0 + CASE WHEN kind = 'Polygon' THEN ax / (3 * a) ELSE lx / l END AS lon, lat0 + CASE WHEN kind = 'Polygon' THEN ay / (3 * a) ELSE ly / l END AS lat FROM sums WHERE (kind = 'Polygon' AND abs(a) > 1e-9) OR (kind = 'LineString' AND l > 0))"""


def _wkt(e):
    """WKT of the ways whose centroid is well defined: lines with a length and rings with an area."""
    kinds = _kinds(e)
    wide = F.abs(geo.total(F.transform(geo.steps("pts"), lambda s: (s["a"]["lon"] - F.col("pts")[0]["lon"]) * (s["b"]["lat"] - F.col("pts")[0]["lat"]) - (s["b"]["lon"] - F.col("pts")[0]["lon"]) * (s["a"]["lat"] - F.col("pts")[0]["lat"])))) > 1e-9
    fine = kinds.where(((F.col("kind") == "Polygon") & wide) | ((F.col("kind") == "LineString") & (geo.line_length("pts") > 0)))
    none = F.array().cast("array<array<struct<lon:double,lat:double>>>")
    return fine.select("id", geo.wkt(F.col("kind"), F.col("pts"), F.when(F.col("kind") == "Polygon", F.array("pts")).otherwise(none), none).alias("wkt"))


@query(CENTRES + " SELECT id, round(lon, 6) AS lon, round(lat, 6) AS lat FROM centres", *GEO)
def wkt_centroid(e):
    """Of lines by length, of rings by area."""
    c = geof.centroid("wkt")
    return _wkt(e).select("id", c.alias("c")).select("id", F.round("c.lon", 6).alias("lon"), F.round("c.lat", 6).alias("lat"))


@query(CENTRES + f" SELECT id, round({_haversine('c.lat', 'c.lon', 'base.lat0', 'base.lon0')}, 2) AS metres FROM centres c JOIN base USING (id)", *GEO)
def wkt_distance(e):
    """From a way's centroid to its first point."""
    first = F.concat(F.lit("POINT("), F.regexp_extract("wkt", r"([-0-9.E]+ [-0-9.E]+)", 1), F.lit(")"))
    return _wkt(e).select("id", F.round(geof.metric_distance("wkt", first), 2).alias("metres"))


# Tiles -----------------------------------------------------------------------

SIDE = f"{2**LEVEL}"
TILE = f", placed AS (SELECT id, CAST(floor((lon + 180) / 360 * {SIDE}) AS bigint) AS x, CAST(floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * {SIDE}) AS bigint) AS y FROM nodes), tiles AS (SELECT x, y, count(*) AS n FROM placed GROUP BY x, y)"
# The hyperbolic sine is spelt out, as not every SQL engine has it.
LAT = f"degrees(atan((exp(pi() * (1 - 2 * {{y}} / {SIDE}.0)) - exp(-pi() * (1 - 2 * {{y}} / {SIDE}.0))) / 2))"


def _tiles(e):
    z = F.lit(LEVEL)
    return e.nodes.select("id", tiles.tile_x(z, F.col("lon")).alias("x"), tiles.tile_y(z, F.col("lat")).alias("y"))


@query(TILE + " SELECT * FROM placed", "nodes")
def lonlat_to_tile(e):
    return _tiles(e)


@query(TILE + " SELECT * FROM tiles", "nodes")
def tile_counts(e):
    return _tiles(e).groupBy("x", "y").agg(F.count("*").alias("n"))


@query(TILE + f" SELECT x, y, round(x / {SIDE}.0 * 360 - 180, 7) AS west, round({LAT.format(y='(y + 1)')}, 7) AS south, round((x + 1) / {SIDE}.0 * 360 - 180, 7) AS east, round({LAT.format(y='y')}, 7) AS north FROM tiles", "nodes")
def tile_bbox(e):
    box = tiles.tile_bbox(F.lit(LEVEL), F.col("x"), F.col("y"))
    return _tiles(e).select("x", "y").distinct().select("x", "y", *[F.round(box[s], 7).alias(s) for s in ("west", "south", "east", "north")])


@query(TILE + f" SELECT DISTINCT y, round(2 * pi() * 6378137 / ({SIDE} * 256) * cos(radians(({LAT.format(y='y')} + {LAT.format(y='(y + 1)')}) / 2)), 6) AS metres FROM tiles", "nodes")
def tile_resolution(e):
    return _tiles(e).select("y").distinct().select("y", F.round(tiles.ground_resolution(F.lit(LEVEL), F.col("y")), 6).alias("metres"))


@query(TILE + f" SELECT x, y, round(x * (2 * pi() * 6378137 / {SIDE}) - pi() * 6378137, 3) AS west, round(pi() * 6378137 - (y + 1) * (2 * pi() * 6378137 / {SIDE}), 3) AS south, round((x + 1) * (2 * pi() * 6378137 / {SIDE}) - pi() * 6378137, 3) AS east, round(pi() * 6378137 - y * (2 * pi() * 6378137 / {SIDE}), 3) AS north FROM tiles", "nodes")
def tile_bbox_3857(e):
    box = tiles.tile_bbox_3857(F.lit(LEVEL), F.col("x"), F.col("y"))
    return _tiles(e).select("x", "y").distinct().select("x", "y", *[F.round(box[s], 3).alias(s) for s in ("west", "south", "east", "north")])


@query(LINES + ", boxes AS (SELECT id, min(lon) AS west, min(lat) AS south, max(lon) AS east, max(lat) AS north FROM placed GROUP BY id) SELECT id, round(6371.0 * radians(east - west) * cos(radians((south + north) / 2)) * 6371.0 * radians(north - south), 4) AS km2 FROM boxes", *GEO)
def viewport_area(e):
    boxed = assemble.way_lines(e).select("id", geo.envelope("pts").alias("e")).select("id", "e.*")
    return boxed.select("id", F.round(tiles.viewport_area(F.col("west"), F.col("south"), F.col("east"), F.col("north")), 4).alias("km2"))


# Text and links --------------------------------------------------------------


@query("SELECT id, 'https://www.wikidata.org/wiki/Q' || v AS url FROM node_tags WHERE k = 'size'", "node_tags")
def wikidata_links(e):
    return e.node_tags.where("k = 'size'").select("id", text.wikidata_url(F.concat(F.lit("Q"), "v")).alias("url"))


@query("SELECT id, 'https://de.wikipedia.org/wiki/' || replace(v, ' ', '_') AS url FROM node_tags WHERE k = 'name:de'", "node_tags")
def wikipedia_links(e):
    return e.node_tags.where("k = 'name:de'").select("id", text.wikipedia_url(F.concat(F.lit("de:"), "v")).alias("url"))


@query("SELECT DISTINCT v, url_encode(v) AS encoded FROM node_tags", "node_tags")
def percent_encode(e):
    return e.node_tags.select("v").distinct().select("v", text.percent_encoded(F.col("v")).alias("encoded"))


# Features, links and descriptions ----------------------------------------------


@query(
    LINES
    + """, shapes AS (SELECT 'node' AS type, id, 'Point' AS kind FROM nodes UNION ALL SELECT 'way', id, kind FROM kinds), props AS (SELECT 'node' AS type, id, count(*) AS n FROM node_tags GROUP BY id UNION ALL SELECT 'way', id, count(*) FROM way_tags GROUP BY id)
    SELECT type, id, kind, coalesce(n, 0) + 2 AS properties FROM shapes LEFT JOIN props USING (type, id)""",
    *GEO, "node_tags", "way_tags",
)
def features_read_back(e):
    """GeoJSON features of all nodes and ways, read again."""
    read = F.from_json("value", "geometry struct<type:string>, properties map<string,string>")
    return features.element_features(e, "nw").select("type", "id", read.alias("f")).select("type", "id", F.col("f.geometry.type").alias("kind"), F.size("f.properties").cast("long").alias("properties"))


@query(
    """, articles AS (SELECT '/osm/node/' || id || '#id' AS s, replace(url_encode(v), '+', '%20') AS title, CASE WHEN id % 10 = 0 THEN 'en' ELSE 'de' END AS lang FROM node_tags WHERE k = 'name:de')
    SELECT s, 'foaf:page' AS p, 'http://' || lang || '.wikipedia.org/wiki/' || title AS o FROM articles UNION ALL SELECT s, 'owl:sameAs', CASE lang WHEN 'en' THEN 'http://dbpedia.org/resource/' ELSE 'http://de.dbpedia.org/resource/' END || title FROM articles
    UNION ALL SELECT '/osm/node/' || id || '#id', 'owl:sameAs', 'http://www.wikidata.org/entity/Q' || v FROM node_tags WHERE k = 'size' UNION ALL SELECT '/osm/node/' || id || '#id', 'rdfs:label', v FROM node_tags WHERE k = 'name:en'""",
    "node_tags",
)
def link_triples(e):
    """Articles, data items and labels of nodes as triples."""
    german = F.concat(F.when(F.col("id") % 10 == 0, "en:").otherwise("de:"), F.col("v"))
    t = e.node_tags.select(F.lit("node").alias("type"), "id", "k", "v")
    linked = t.where("k = 'name:de'").select("type", "id", F.lit("wikipedia").alias("k"), german.alias("v")).union(t.where("k = 'size'").select("type", "id", F.lit("wikidata"), F.concat(F.lit("Q"), F.col("v")))).union(t.where("k = 'name:en'"))
    return rdf.link_triples(linked).select("s", "p", "o")


@query(TILE + f" SELECT '/tile/plain/{LEVEL}/' || x || '/' || y AS s, 'dcterms:title' AS p, 'plain tile {LEVEL}/' || x || '/' || y AS o FROM tiles UNION ALL SELECT '/tile/plain/{LEVEL}/' || x || '/' || y, 'dcterms:spatial', '_:tile-{LEVEL}-' || x || '-' || y FROM tiles UNION ALL SELECT '/tile/plain/{LEVEL}/' || x || '/' || y, 'dcterms:license', unnest(['https://opendatacommons.org/licenses/odbl/1-0/', 'https://creativecommons.org/licenses/by/4.0/']) FROM tiles", "nodes")
def tile_descriptions(e):
    """Titles, licences and places of all tiles that hold a node."""
    found = _tiles(e).select(F.lit(LEVEL).alias("z"), "x", "y").distinct()
    t = rdf.tile_triples(found, "plain", "https://example.org/tiles", ["https://opendatacommons.org/licenses/odbl/1-0/", "https://creativecommons.org/licenses/by/4.0/"])
    return t.where("p IN ('dcterms:title', 'dcterms:license', 'dcterms:spatial')").select("s", "p", "o")


@query(TAGS + ", keys AS (SELECT k FROM (SELECT k, count(*) AS uses FROM tags GROUP BY k ORDER BY uses DESC, k LIMIT 200) WHERE regexp_matches(k, '^[^*:+A-Z][^:]*$')) SELECT '/tag/' || url_encode(k) || '#concept' AS s, unnest(['rdf:type', 'skos:notation', 'skos:inScheme']) AS p, unnest(['skos:Concept', k, '/tag/#scheme']) AS o FROM keys", *TAGGED)
def key_concepts(e):
    """The key index as a scheme of concepts."""
    return rdf.key_triples(tags.key_index(select.all_tags(e))).select("s", "p", "o")


@query("SELECT DISTINCT v, CASE WHEN regexp_full_match(v, '[0-9]+') AND TRY_CAST(v AS bigint) > 0 THEN CAST(v AS bigint) END AS id FROM node_tags", "node_tags")
def element_ids(e):
    """Texts as ids of elements: positive whole numbers only."""
    return e.node_tags.select("v").distinct().select("v", text.element_id(F.col("v")).alias("id"))


# Triples ---------------------------------------------------------------------

TRIPLES = (
    TAGS
    + """, members AS (SELECT * FROM relation_members), named AS (SELECT 'node' AS type, id FROM nodes UNION ALL SELECT 'way', id FROM ways UNION ALL SELECT 'relation', id FROM relations),
    triples AS MATERIALIZED (
        SELECT '/osm/' || type || '/' || id || '#id' AS s, 'rdf:type' AS p, 'osm:' || upper(type[1]) || type[2:] AS o, 'iri' AS o_kind, NULL AS o_datatype FROM named
        UNION SELECT '/osm/' || type || '/' || id || '#id', 'dcterms:identifier', id::varchar, 'literal', NULL FROM named
        UNION SELECT '/osm/node/' || id || '#id', 'geo:lat', format('{}.{:07d}', lat7 // 10000000, lat7 % 10000000), 'literal', 'xsd:decimal' FROM nodes
        UNION SELECT '/osm/node/' || id || '#id', 'geo:long', format('{}.{:07d}', lon7 // 10000000, lon7 % 10000000), 'literal', 'xsd:decimal' FROM nodes
        UNION SELECT '/osm/' || type || '/' || id || '#id', '/tag/' || k, v, 'literal', NULL FROM tags
        UNION SELECT '/osm/' || type || '/' || id || '#id', 'dc:subject', '/tag/' || url_encode(k) || '=' || url_encode(v) || '#concept', 'iri', NULL FROM tags
        UNION SELECT '/osm/relation/' || rel_id || '#id', 'rdfs:seeAlso', '/osm/' || type || '/' || ref || '#id', 'iri', NULL FROM members)"""
)
ALL = ("nodes", "ways", "relations", "relation_members", *TAGGED)


@query(TRIPLES + " SELECT * FROM triples", *ALL)
def triples_elements(e):
    return rdf.element_triples(e)


@query(TRIPLES + " SELECT s, o FROM triples WHERE p = 'dc:subject'", *ALL)
def triples_subjects(e):
    return graph.match(rdf.element_triples(e), "?s", "dc:subject", "?o")


@query(
    f", c AS ({CONFIRMED.strip()}) SELECT DISTINCT s, p, o FROM (SELECT '/tag/size=' || v || '#concept' AS s, 'rdf:type' AS p, 'skos:Concept' AS o FROM c UNION ALL SELECT '/tag/size=' || v || '#concept', 'skos:notation', v FROM c UNION ALL SELECT '/tag/size#concept', CASE WHEN confirmed THEN 'skos:narrower' ELSE 'skos:example' END, CASE WHEN confirmed THEN '/tag/size=' || v || '#concept' ELSE v END FROM c)",
    "node_tags",
)
def concept_scheme(e):
    return tags.concepts(e.node_tags, _documented(e), "size")


@query(
    """SELECT s, p, o FROM (SELECT '/changeset/' || id AS s, 'rdf:type' AS p, 'prov:Activity' AS o FROM changesets UNION ALL SELECT '/changeset/' || id, 'prov:endedAtTime', strftime(created_at, '%Y-%m-%dT%H:%M:%SZ') FROM changesets
    UNION ALL SELECT '/changeset/' || id, 'prov:wasAssociatedWith', '/user/' || user_id FROM changesets UNION ALL SELECT '/changeset/' || id, 'rdfs:comment', comment FROM changesets) WHERE o IS NOT NULL""",
    "changesets",
)
def changeset_activities(e):
    return rdf.changeset_triples(e.changesets).select("s", "p", "o")


@query(TRIPLES + " SELECT p, count(*) AS n FROM triples GROUP BY p", *ALL)
def graph_merge(e):
    """Two overlapping documents merge into one set of triples."""
    t = rdf.element_triples(e)
    halves = t.where("p <> 'geo:lat'"), t.where("p <> 'geo:long'")
    return rdf.merged(*halves).groupBy("p").agg(F.count("*").alias("n"))


# Graph patterns: the shipped example questions, then one for each operator ----


@query(f" SELECT url_encode(k) || '=' || url_encode(v) AS tag, count(*) AS features FROM node_tags JOIN nodes USING (id) WHERE {BBOX_SQL} GROUP BY 1", "nodes", "node_tags")
def graph_tag_counts(e):
    """How often each tag occurs in a box."""
    inside = Elements(**{**e.__dict__, "nodes": select.nodes_in(e, BBOX)})
    tagged = e.node_tags.join(inside.nodes.select("id"), "id", "left_semi")
    concept = F.concat(text.percent_encoded(F.col("k")), F.lit("="), text.percent_encoded(F.col("v")))
    return tagged.select(concept.alias("tag")).groupBy("tag").agg(F.count("*").alias("features"))


@query(LINES + f", hit AS MATERIALIZED (SELECT DISTINCT way_id AS id FROM way_nodes JOIN nodes ON node_id = nodes.id WHERE {BBOX_SQL}) SELECT '/osm/way/' || id || '#id' AS s, kind, n FROM kinds JOIN hit USING (id)", *GEO)
def graph_features_with_geometry(e):
    """All ways in a box with their geometry's kind and number of points."""
    lines = assemble.way_lines(e, select.ways_in(e, BBOX))
    return lines.select(rdf.subject(F.lit("way"), F.col("id")).alias("s"), geo.line_kind("pts").alias("kind"), F.size("pts").cast("long").alias("n"))


@query(LINES + f" SELECT id, round({AREA}) AS m2 FROM placed JOIN kinds USING (id) WHERE kind = 'Polygon' AND id IN (SELECT id FROM way_tags WHERE k = 'building') GROUP BY id ORDER BY m2 DESC, id LIMIT 10", *GEO, "way_tags")
def graph_building_areas(e):
    """The ten largest buildings."""
    buildings = e.way_tags.where(select.tag_condition("building")).select("id").distinct()
    lines = assemble.way_lines(e, buildings).where(geo.is_closed("pts"))
    return lines.select("id", F.round(geo.ring_area("pts")).alias("m2")).orderBy(F.desc("m2"), "id").limit(10)


@query(LINES + HISTOGRAM, *GEO)
def graph_dimension_histogram(e):
    return dimension_histogram(e)


@query(LINES + f" SELECT id, round({LENGTH}) AS metres FROM placed JOIN kinds USING (id) WHERE kind = 'LineString' AND id IN (SELECT id FROM way_tags WHERE k = 'highway') GROUP BY id ORDER BY metres DESC, id LIMIT 10", *GEO, "way_tags")
def graph_street_lengths(e):
    """The ten longest streets."""
    streets = e.way_tags.where(select.tag_condition("highway")).select("id").distinct()
    lines = assemble.way_lines(e, streets).where(geo.line_kind("pts") == "LineString")
    return lines.select("id", F.round(geo.line_length("pts")).alias("metres")).orderBy(F.desc("metres"), "id").limit(10)


def _terms(e):
    return rdf.element_triples(e).select("s", "p", "o")


@query(TRIPLES + " SELECT DISTINCT s, p, o FROM triples a WHERE p IN ('geo:lat', 'dc:subject') AND s IN (SELECT s FROM triples WHERE p = 'geo:lat') AND s IN (SELECT s FROM triples WHERE p = 'dc:subject')", *ALL)
def graph_construct(e):
    found = graph.every(_terms(e), ("?s", "geo:lat", "?lat"), ("?s", "dc:subject", "?tag"))
    return graph.construct(found, ("?s", "geo:lat", "?lat"), ("?s", "dc:subject", "?tag"))


@query(TRIPLES + " SELECT a.s, a.o AS name, b.o AS en FROM triples a LEFT JOIN triples b ON a.s = b.s AND b.p = '/tag/name:en' WHERE a.p = '/tag/name'", *ALL)
def graph_optional(e):
    t = _terms(e)
    return graph.optional(graph.match(t, "?s", "/tag/name", "?name"), graph.match(t, "?s", "/tag/name:en", "?en"))


@query(TRIPLES + " SELECT s, o AS en, NULL AS de FROM triples WHERE p = '/tag/name:en' UNION ALL SELECT s, NULL, o FROM triples WHERE p = '/tag/name:de'", *ALL)
def graph_union(e):
    t = _terms(e)
    return graph.union(graph.match(t, "?s", "/tag/name:en", "?en"), graph.match(t, "?s", "/tag/name:de", "?de"))


@query(TRIPLES + " SELECT s FROM triples WHERE p = '/tag/name' AND s NOT IN (SELECT s FROM triples WHERE p = '/tag/name:en')", *ALL)
def graph_minus(e):
    t = _terms(e)
    return graph.minus(graph.match(t, "?s", "/tag/name", "?name"), graph.match(t, "?s", "/tag/name:en", "?en")).select("s")


@query(TRIPLES + " SELECT s FROM triples WHERE p = '/tag/name' AND s IN (SELECT s FROM triples WHERE p = '/tag/name:en')", *ALL)
def graph_exists(e):
    t = _terms(e)
    return graph.exists(graph.match(t, "?s", "/tag/name", "?name"), graph.match(t, "?s", "/tag/name:en", "?en")).select("s")


@query(TRIPLES + " SELECT s, o AS v, upper(o) AS u FROM triples WHERE p = '/tag/highway' AND o IN ('1-URGENT', '2-HIGH')", *ALL)
def graph_values_bind(e):
    """VALUES as a membership test, BIND as a computed column."""
    return graph.match(_terms(e), "?s", "/tag/highway", "?v").where(F.col("v").isin("1-URGENT", "2-HIGH")).withColumn("u", F.upper("v"))


@query(TRIPLES + " SELECT a.s, a.o AS brand, n FROM triples a JOIN (SELECT o, count(*) AS n FROM triples WHERE p = '/tag/brand' GROUP BY o) c ON a.o = c.o WHERE a.p = '/tag/brand'", *ALL)
def graph_subquery(e):
    brands = graph.match(_terms(e), "?s", "/tag/brand", "?brand")
    return brands.join(brands.groupBy("brand").agg(F.count("*").alias("n")), "brand").select("s", "brand", "n")


@query(TRIPLES + " SELECT o AS tag, count(*) AS n FROM triples WHERE p = 'dc:subject' GROUP BY o HAVING count(*) > 100", *ALL)
def graph_having(e):
    return graph.match(_terms(e), "?s", "dc:subject", "?tag").groupBy("tag").agg(F.count("*").alias("n")).where("n > 100")


@query(TRIPLES + " SELECT s, string_agg(o, ',' ORDER BY o) AS tags FROM triples WHERE p = 'dc:subject' GROUP BY s", *ALL)
def graph_group_concat(e):
    return graph.match(_terms(e), "?s", "dc:subject", "?tag").groupBy("s").agg(F.array_join(F.array_sort(F.collect_list("tag")), ",").alias("tags"))


@query(TRIPLES + " SELECT DISTINCT o AS brand FROM triples WHERE p = '/tag/brand' ORDER BY o LIMIT 5 OFFSET 3", *ALL)
def graph_distinct_offset(e):
    return graph.match(_terms(e), "?s", "/tag/brand", "?brand").select("brand").distinct().orderBy("brand").offset(3).limit(5)


@query(
    TRIPLES
    + """, l1 AS (SELECT s, o FROM triples WHERE p = 'rdfs:seeAlso'), l2 AS (SELECT DISTINCT l1.s, b.o FROM l1 JOIN l1 b ON l1.o = b.s), l3 AS (SELECT DISTINCT l2.s, b.o FROM l2 JOIN l1 b ON l2.o = b.s)
    SELECT * FROM l1 UNION SELECT * FROM l2 UNION SELECT * FROM l3""",
    *ALL,
)
def graph_path_plus(e):
    return graph.path_plus(graph.match(_terms(e), "?s", "rdfs:seeAlso", "?o"))


@query(TRIPLES + " SELECT count(*) > 0 AS answer FROM triples WHERE p = '/tag/building' AND o = 'yes'", *ALL)
def graph_ask(e):
    return graph.match(_terms(e), "?s", "/tag/building", "yes").agg((F.count("*") > 0).alias("answer"))


@query(TRIPLES + ", subjects AS MATERIALIZED (SELECT DISTINCT '/osm/relation/' || id || '#id' AS s FROM relation_tags WHERE k = 'type' AND v = 'boundary') SELECT s, p, o FROM triples JOIN subjects USING (s)", *ALL)
def graph_describe(e):
    """The triples are written once, so that the pattern and each round of the description read only what they need."""
    t = materialize(_terms(e))
    return graph.describe(t, graph.match(t, "?s", "/tag/type", "boundary"))


AGENTS = """, activities AS (SELECT id, '/changeset/' || id AS s, '_:agent' || id AS agent, strftime(created_at, '%Y-%m-%dT%H:%M:%SZ') AS ended, user_id, comment FROM changesets),
    activity_triples AS (SELECT s, 'rdf:type' AS p, 'prov:Activity' AS o FROM activities UNION ALL SELECT s, 'prov:endedAtTime', ended FROM activities UNION ALL SELECT s, 'rdfs:comment', comment FROM activities UNION ALL SELECT s, 'prov:wasAssociatedWith', agent FROM activities
    UNION ALL SELECT agent, 'rdf:type', 'prov:Agent' FROM activities UNION ALL SELECT agent, 'foaf:accountName', CAST(user_id AS varchar) FROM activities UNION ALL SELECT agent, 'foaf:homepage', 'https://www.openstreetmap.org/user/' || user_id FROM activities
    UNION ALL SELECT agent, 'foaf:accountServiceHomepage', 'https://www.openstreetmap.org' FROM activities)"""


@query(AGENTS + " SELECT s, p, o FROM activity_triples WHERE o IS NOT NULL AND (s IN (SELECT s FROM activities WHERE id % 50 = 0) OR s IN (SELECT agent FROM activities WHERE id % 50 = 0))", "changesets")
def graph_describe_blank(e):
    """Changesets with the blank nodes that they lead to."""
    t = materialize(rdf.activity_triples(e.changesets).select("s", "p", "o"))
    wanted = e.changesets.where("id % 50 = 0").select(F.concat(F.lit("/changeset/"), F.col("id").cast("string")).alias("s"))
    return graph.describe(t, wanted)


# The shipped examples once more, as patterns over the triples of a box's document ----

DOCUMENT = (
    TAGS
    + f""", inside AS MATERIALIZED (SELECT id FROM nodes WHERE {BBOX_SQL}), chosen AS MATERIALIZED (
        SELECT 'node' AS type, id FROM inside UNION SELECT 'way', way_id FROM way_nodes WHERE node_id IN (SELECT id FROM inside)
        UNION SELECT 'relation', rel_id FROM relation_members WHERE type = 'way' AND ref IN (SELECT way_id FROM way_nodes WHERE node_id IN (SELECT id FROM inside)) OR type = 'node' AND ref IN (SELECT id FROM inside)),
    subjects AS MATERIALIZED (SELECT DISTINCT '/osm/' || type || '/' || id || '#id' AS s, '/tag/' || url_encode(k) || '=' || url_encode(v) || '#concept' AS tag FROM tags JOIN chosen USING (type, id)),
    placed AS (SELECT way_id AS id, seq, lon, lat, format('{{}}.{{:07d}} {{}}.{{:07d}}', lon7 // 10000000, lon7 % 10000000, lat7 // 10000000, lat7 % 10000000) AS t, lead(lon) OVER w AS lon2, lead(lat) OVER w AS lat2 FROM way_nodes JOIN nodes ON node_id = nodes.id WINDOW w AS (PARTITION BY way_id ORDER BY seq)),
    shapes AS MATERIALIZED (SELECT id, count(*) AS n, string_agg(t, ', ' ORDER BY seq) AS pts, min_by(t, seq) = max_by(t, seq) AS closed, round({AREA}) AS m2, round({LENGTH}) AS metres FROM placed GROUP BY id),
    geometry AS MATERIALIZED (
        SELECT '/osm/way/' || id || '#id' AS s, CASE WHEN closed THEN 'POLYGON((' || pts || '))' ELSE 'LINESTRING(' || pts || ')' END AS wkt, CASE WHEN NOT closed THEN 1 WHEN n >= 4 THEN 2 END AS dim, CASE WHEN closed AND n >= 4 THEN coalesce(m2, 0) END AS m2, metres, id, 'way' AS type
        FROM shapes WHERE id IN (SELECT id FROM chosen WHERE type = 'way')
        UNION ALL SELECT '/osm/node/' || id || '#id', format('POINT({{}}.{{:07d}} {{}}.{{:07d}})', lon7 // 10000000, lon7 % 10000000, lat7 // 10000000, lat7 % 10000000), 0, 0, 0, id, 'node' FROM nodes WHERE id IN (SELECT id FROM inside))"""
)
BOXED = ("nodes", "way_nodes", "relation_members", *TAGGED)


def _document(e, tag=None):
    return rdf.feature_triples(e, materialize(rdf.box_features(e, BBOX, tag))).select("s", "p", "o")


@query(DOCUMENT + " SELECT tag, count(*) AS features FROM subjects GROUP BY tag", *BOXED)
def example_tag_counts(e):
    return graph.match(_document(e), "?s", rdf.SUBJECT, "?tag").groupBy("tag").agg(F.count("s").alias("features"))


@query(DOCUMENT + " SELECT s, wkt FROM geometry ORDER BY s LIMIT 20", *BOXED)
def example_features(e):
    """The first twenty subjects with their geometry."""
    return graph.match(_document(e), "?s", rdf.GEOMETRY, "?wkt").orderBy("s").limit(20)


@query(DOCUMENT + " SELECT s, m2 FROM geometry WHERE starts_with(wkt, 'POLYGON') AND m2 IS NOT NULL AND id IN (SELECT id FROM way_tags WHERE k = 'building') ORDER BY m2 DESC, s LIMIT 10", *BOXED)
def example_building_areas(e):
    found = graph.match(_document(e, "building"), "?s", rdf.GEOMETRY, "?wkt").where(F.startswith("wkt", F.lit("POLYGON")))
    sized = found.select("s", F.round(geof.metric_area("wkt")).alias("m2")).where("m2 IS NOT NULL")
    return sized.orderBy(F.desc("m2"), "s").limit(10)


@query(DOCUMENT + " SELECT dim, count(*) AS features FROM geometry GROUP BY dim", *BOXED)
def example_dimensions(e):
    """A ring too short for a polygon has no dimension."""
    found = graph.match(_document(e), "?s", rdf.GEOMETRY, "?wkt").select("s", geof.dimension("wkt").alias("dim"))
    return found.groupBy("dim").agg(F.count("s").alias("features"))


@query(DOCUMENT + " SELECT s, metres FROM geometry WHERE dim = 1 AND id IN (SELECT id FROM way_tags WHERE k = 'highway') ORDER BY metres DESC, s LIMIT 10", *BOXED)
def example_street_lengths(e):
    found = graph.match(_document(e, "highway"), "?s", rdf.GEOMETRY, "?wkt").where(geof.dimension("wkt") == 1)
    return found.select("s", F.round(geof.metric_length("wkt")).alias("metres")).orderBy(F.desc("metres"), "s").limit(10)


@query(DOCUMENT + " SELECT DISTINCT s, 'locn:geometry' AS p, wkt AS o FROM geometry UNION SELECT s, 'dc:subject', tag FROM subjects JOIN geometry USING (s)", *BOXED)
def example_subgraph(e):
    t = materialize(_document(e))
    found = graph.every(t, ("?s", rdf.GEOMETRY, "?wkt"), ("?s", rdf.SUBJECT, "?tag"))
    return graph.construct(found, ("?s", rdf.GEOMETRY, "?wkt"), ("?s", rdf.SUBJECT, "?tag"))


# Paths ------------------------------------------------------------------------

EDGES = TRIPLES + ", links AS MATERIALIZED (SELECT s, o FROM triples WHERE p = 'rdfs:seeAlso' AND s IN (SELECT '/osm/relation/' || id || '#id' FROM relations WHERE id >= 100000000)), typed AS MATERIALIZED (SELECT s, o FROM triples WHERE p = 'rdf:type' AND s IN (SELECT s FROM links UNION SELECT o FROM links)), named_ AS MATERIALIZED (SELECT s, o FROM triples WHERE p = '/tag/name' AND s IN (SELECT s FROM links UNION SELECT o FROM links)), g AS MATERIALIZED (SELECT s, 'rdfs:seeAlso' AS p, o FROM links UNION ALL SELECT s, 'rdf:type', o FROM typed UNION ALL SELECT s, '/tag/name', o FROM named_)"


def _links(e):
    """Links of the large relations to their members, with the types and names of both."""
    t = materialize(_terms(e))
    large = e.relations.where("id >= 100000000").select(rdf.subject(F.lit("relation"), F.col("id")).alias("s"))
    links = materialize(t.where("p = 'rdfs:seeAlso'").join(large, "s", "left_semi"))
    nodes = links.select("s").union(links.select("o")).distinct()
    return materialize(links.union(t.where("p IN ('rdf:type', '/tag/name')").join(nodes, "s", "left_semi")))


SEE, NAME, KIND = paths.P("rdfs:seeAlso"), paths.P("/tag/name"), paths.P("rdf:type")


@query(EDGES + " SELECT links.s, named_.o FROM links JOIN named_ ON links.o = named_.s", *ALL)
def graph_path_sequence(e):
    return paths.pairs(_links(e), SEE / NAME)


@query(EDGES + " SELECT s, o FROM named_ UNION ALL SELECT s, o FROM typed", *ALL)
def graph_path_either(e):
    return paths.pairs(_links(e), NAME | KIND)


@query(EDGES + " SELECT a.o AS s, b.o FROM links a JOIN named_ b ON a.s = b.s", *ALL)
def graph_path_inverse(e):
    """From a member to the names of what it belongs to."""
    return paths.pairs(_links(e), ~SEE / NAME)


@query(EDGES + " SELECT s, o FROM g WHERE p <> 'rdfs:seeAlso' AND p <> 'rdf:type' UNION ALL SELECT o, s FROM g WHERE p <> '/tag/name' AND p <> 'rdf:type'", *ALL)
def graph_path_not(e):
    return paths.pairs(_links(e), paths.Not(SEE, KIND, ~NAME, ~KIND))


@query(EDGES + ", every AS (SELECT s AS n FROM g UNION SELECT o FROM g) SELECT n AS s, n AS o FROM every UNION SELECT s, o FROM links", *ALL)
def graph_path_optional(e):
    return paths.pairs(_links(e), SEE.opt())


@query(EDGES + ", every AS (SELECT s AS n FROM g UNION SELECT o FROM g) SELECT n AS s, n AS o FROM every UNION SELECT s, o FROM links UNION SELECT a.s, b.o FROM links a JOIN links b ON a.o = b.s UNION SELECT a.s, c.o FROM links a JOIN links b ON a.o = b.s JOIN links c ON b.o = c.s", *ALL)
def graph_path_star(e):
    return paths.pairs(_links(e), SEE.star())


@query(
    EDGES
    + """, up AS (SELECT o AS n, s AS m FROM links UNION SELECT s, o FROM links) SELECT * FROM (
    WITH RECURSIVE walk AS (SELECT s AS a, s AS z FROM named_ WHERE o = 'NATION_3' UNION SELECT walk.a, up.m FROM walk JOIN up ON walk.z = up.n)
    SELECT walk.a AS s, named_.o FROM walk JOIN named_ ON walk.z = named_.s)""",
    *ALL,
)
def graph_path_cycles(e):
    """All names that can be reached from one nation along links in both directions, any number of times."""
    t = _links(e)
    start = t.where("p = '/tag/name' AND o = 'NATION_3'").select(F.col("s").alias("n"))
    return paths.pairs(t, (SEE | ~SEE).star() / NAME, start)


# Named graphs -----------------------------------------------------------------

QUADS = TRIPLES + ", quads AS MATERIALIZED (SELECT '/graph/' || split_part(s, '/', 3) AS g, s, p, o FROM triples UNION ALL SELECT '/graph/names', s, p, o FROM triples WHERE p = '/tag/name')"


def _quads(e):
    t = materialize(_terms(e))
    of_type = t.withColumn("g", F.concat(F.lit("/graph/"), F.split_part("s", F.lit("/"), F.lit(3))))
    return of_type.union(t.where("p = '/tag/name'").withColumn("g", F.lit("/graph/names")))


@query(QUADS + " SELECT p, count(*) AS n FROM (SELECT DISTINCT s, p, o FROM quads WHERE g IN ('/graph/way', '/graph/names')) GROUP BY p", *ALL)
def graph_from(e):
    """Several graphs merge into the default one; what two of them say counts once."""
    return graph.Dataset(_quads(e), default=["/graph/way", "/graph/names"], base="/graph/").default.groupBy("p").agg(F.count("*").alias("n"))


@query(QUADS + " SELECT a.g, a.s, a.o AS name, b.o AS kind FROM quads a JOIN quads b ON a.g = b.g AND a.s = b.s WHERE a.p = '/tag/name' AND b.p = 'rdf:type' AND a.g IN ('/graph/node', '/graph/relation', '/graph/names')", *ALL)
def graph_variable(e):
    """Patterns within each named graph: the one that holds names only has no types."""
    d = graph.Dataset(_quads(e), named=["/graph/node", "/graph/relation", "/graph/names"], base="/graph/")
    return d.graph("?g", ("?s", "/tag/name", "?name"), ("?s", "rdf:type", "?kind"))


@query(QUADS + " SELECT q.s, q.o AS name, d.o AS id FROM quads q JOIN quads d ON q.s = d.s AND d.g = '/graph/node' AND d.p = 'dcterms:identifier' WHERE q.g = '/graph/names' AND q.p = '/tag/name'", *ALL)
def graph_named(e):
    """One named graph beside the default one."""
    d = graph.Dataset(_quads(e), default=["/graph/node"], named=["/graph/names"], base="/graph/")
    return graph.match(d.default, "?s", "dcterms:identifier", "?id").join(d.graph("/graph/names", ("?s", "/tag/name", "?name")), "s").select("s", "name", "id")


@query(
    TRIPLES
    + """, en AS (SELECT s, o AS label FROM triples WHERE p = '/tag/name:en'), de AS (SELECT s, o AS label FROM triples WHERE p = '/tag/name:de'),
    a AS (SELECT n.s, en.label FROM triples n LEFT JOIN en ON n.s = en.s WHERE n.p = '/tag/name' AND n.s LIKE '/osm/node/%')
    SELECT a.s, coalesce(a.label, de.label) AS label FROM a LEFT JOIN de ON a.s = de.s AND (a.label IS NULL OR a.label = de.label)""",
    *ALL,
)
def graph_optional_unbound(e):
    """A label that the first OPTIONAL leaves unbound is bound by the second one."""
    t = materialize(_terms(e).where("p IN ('/tag/name', '/tag/name:en', '/tag/name:de') AND s LIKE '/osm/node/%'"))
    a = graph.optional(graph.match(t, "?s", "/tag/name", "?name"), graph.match(t, "?s", "/tag/name:en", "?label"))
    return graph.optional(a, graph.match(t, "?s", "/tag/name:de", "?label"), unbound=["label"]).select("s", "label")


@query(
    """, sized AS (SELECT DISTINCT v FROM node_tags WHERE k = 'size'), mixed AS (SELECT 3 AS rank, v::double AS number, v AS value FROM sized UNION ALL SELECT 3, NULL, v FROM (SELECT DISTINCT v FROM node_tags WHERE k = 'brand')
        UNION ALL SELECT 2, NULL, '/osm/relation/' || id || '#id' FROM relations WHERE id >= 100000000 UNION ALL SELECT 1, NULL, '_:agent' || id FROM changesets WHERE id <= 8)
    SELECT CASE rank WHEN 1 THEN 'blank' WHEN 2 THEN 'iri' ELSE 'literal' END AS kind, value FROM mixed ORDER BY rank, number NULLS LAST, value LIMIT 60""",
    "node_tags", "relations", "changesets",
)
def graph_term_order(e):
    """The first of blank nodes, addresses, numbers by value, and texts."""
    sized = e.node_tags.where("k = 'size'").select("v").distinct().select(terms.literal(F.col("v"), "xsd:integer").alias("t"))
    brands = e.node_tags.where("k = 'brand'").select("v").distinct().select(terms.literal(F.col("v")).alias("t"))
    large = e.relations.where("id >= 100000000").select(terms.iri(rdf.subject(F.lit("relation"), F.col("id"))).alias("t"))
    agents = e.changesets.where("id <= 8").select(terms.blank(F.concat(F.lit("_:agent"), F.col("id").cast("string"))).alias("t"))
    mixed = brands.union(sized).union(large).union(agents)
    return mixed.orderBy(*terms.order(F.col("t"))).limit(60).select("t.kind", "t.value")


@query(TRIPLES + " SELECT s, count(DISTINCT p) AS predicates, count(*) AS objects FROM (SELECT DISTINCT s, p, o FROM triples) GROUP BY s", *ALL)
def turtle_blocks(e):
    """Blocks of Turtle, counted again: a line for each predicate, objects in a row."""
    lines = F.regexp_count("value", F.lit(r" ;\n")) + 1
    return rdf_text.turtle(rdf.element_triples(e), "https://example.org").select("s", lines.cast("long").alias("predicates"), (F.regexp_count("value", F.lit(r", [\"<a-z]")) + lines).cast("long").alias("objects"))


@query(DOCUMENT + " SELECT s, CASE dim WHEN 0 THEN 'Point' WHEN 1 THEN 'LineString' WHEN 2 THEN 'Polygon' END AS kind, count(tag) > 0 AS tagged FROM (SELECT s FROM subjects UNION SELECT s FROM geometry) LEFT JOIN geometry USING (s) LEFT JOIN subjects USING (s) GROUP BY s, dim", *BOXED)
def triples_geojson(e):
    """The box's document as GeoJSON features, read again."""
    t = rdf.feature_triples(e, materialize(rdf.box_features(e, BBOX)))
    read = F.from_json("value", "id string, geometry struct<type:string>, properties map<string,string>")
    return rdf_text.geojson_of_triples(t).select(read.alias("f")).select("f.id", "f.geometry.type", F.map_keys("f.properties").alias("k")).select(F.col("id").alias("s"), F.col("type").alias("kind"), F.array_contains("k", rdf.SUBJECT).alias("tagged"))


# Text forms of geometry ------------------------------------------------------


def _written(df, form):
    return df.select("id", form(F.col("kind"), F.col("pts"), F.col("outers"), F.col("inners")).alias("value"))


def wkt_lines_of(e):
    return _written(assemble.way_geometries(e), geo.wkt)


@query()
def wkt_lines(e):
    return wkt_lines_of(e)


@query()
def geojson_features(e):
    """One GeoJSON feature with its tags for each way."""
    lists = e.way_tags.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "k", "v"))), lambda t: F.struct(t["k"].alias("k"), t["v"].alias("v"))).alias("tags"))
    g = assemble.way_geometries(e).join(lists, "id", "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<struct<k:string,v:string>>")))
    geometry = geo.geojson(F.col("kind"), F.col("pts"), F.col("outers"), F.col("inners"))
    return g.select("id", geo.feature(rdf.subject(F.lit("way"), F.col("id")), [("osm_type", F.lit("way")), ("osm_id", F.col("id"))], F.col("tags"), geometry).alias("value"))


@query(LINES + " SELECT id, kind, n FROM kinds", *GEO)
def wkt_read_back(e):
    """Ways written as text and read again: kind and number of points."""
    read = wkt_lines_of(e).select("id", geo.parse_wkt("value").alias("g"))
    return read.select("id", "g.kind", (F.size("g.pts") + F.aggregate("g.rings", F.lit(0), lambda a, r: a + F.size(r))).cast("long").alias("n"))


@query()
def kml_polygons(e):
    return _written(assemble.relation_geometries(e, areas_only=True), geo.kml)


@query()
def gml_polygons(e):
    return _written(assemble.relation_geometries(e, areas_only=True), geo.gml)


@query()
def ntriples(e):
    return rdf.ntriples(rdf.element_triples(e), "https://example.org")
