"""GeoJSON features of elements, and of documents whose elements carry their coordinates themselves.

Features are a row each (type, id, value); ``rdf_text.write_collection`` writes
them as collections, so none is gathered in one place.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.functions import geo
from quadrille.functions.text import XML, escaped, property_value
from quadrille.operators import assemble
from quadrille.operators.rdf import subject
from quadrille.operators.select import TYPES
from quadrille.operators.solutions import framed
from quadrille.sources.elements import Elements

LINE = "array<struct<lon:double,lat:double>>"
TAGS = "array<struct<k:string,v:string>>"


def _feature(kind: str, tags: Column, geometry: Column, named: bool = True) -> Column:
    id = F.col("id")
    given = [("osm_type", F.lit(kind)), ("osm_id", id.cast("string"))]
    return geo.feature(subject(F.lit(kind), id) if named else None, given, tags, geometry, geo.CONTEXT if named else None, property_value)


def _with_tags(df: DataFrame, tags: DataFrame) -> DataFrame:
    lists = tags.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "k", "v"))), lambda t: F.struct(t["k"].alias("k"), t["v"].alias("v"))).alias("tags"))
    return df.join(lists, "id", "left").withColumn("tags", F.coalesce("tags", F.array().cast(TAGS)))


def element_features(e: Elements, kind: str = "nwr") -> DataFrame:
    """(type, id, value) of the elements of the wanted types that have a place; articles and data items become links."""
    none = F.array().cast(f"array<{LINE}>")
    shapes = {"node": lambda: (e.nodes.select("id", F.lit("Point").alias("kind"), F.array(geo.point("lon", "lat")).alias("pts"), none.alias("outers"), none.alias("inners")), e.node_tags)}
    shapes |= {"way": lambda: (assemble.way_geometries(e), e.way_tags), "relation": lambda: (assemble.relation_geometries(e).where("kind <> 'Empty'"), e.relation_tags)}
    geometry = geo.geojson(*[F.col(c) for c in ("kind", "pts", "outers", "inners")])
    parts = [_with_tags(*shapes[t]()).select(F.lit(t).alias("type"), "id", _feature(t, F.col("tags"), geometry).alias("value")) for t in TYPES if t[0] in kind]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def role_kind(role: Column) -> Column:
    """``outer`` and ``inner`` by their exact names; anything else is ``other``."""
    return F.when(role.isin("outer", "inner"), role).otherwise("other")


def inline_relations(relations: DataFrame) -> DataFrame:
    """(id, kind, pts, lines, outers, inners, tags) of relations (id, members, tags) whose members have points of their own.

    With outer members they are stitched to polygons; without, all other and then inner members are lines of their own.
    Members of fewer than two points are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pts = pa.list_(pa.struct([("lon", pa.float64()), ("lat", pa.float64())]))
        as_struct = lambda line: [{"lon": x, "lat": y} for x, y in line]
        for batch in batches:
            out = [], []
            for rows in batch.column(1).to_pylist():
                parts = {k: [[(p["lon"], p["lat"]) for p in m["pts"]] for m in rows or [] if m["role"] == k] for k in ("outer", "inner")}
                outers = assemble.stitch(parts["outer"]) if parts["outer"] else []
                inners = assemble.stitch(parts["inner"]) if outers else []
                out[0].append([as_struct(r) for r in outers])
                out[1].append([as_struct(r) for r in inners])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[0], pa.list_(pts)), pa.array(out[1], pa.list_(pts)), *batch.columns[1:]], ["id", "outers", "inners", "m", "tags"])

    members = F.coalesce(F.col("members"), F.array().cast("array<struct<type:string,ref:bigint,role:string,pts:array<struct<lon:double,lat:double>>>>"))
    placed = F.filter(F.transform(members, lambda m: F.struct(role_kind(m["role"]).alias("role"), F.filter(F.coalesce(m["pts"], F.array().cast(LINE)), lambda p: p["lon"].isNotNull() & p["lat"].isNotNull()).alias("pts"))), lambda m: F.size(m["pts"]) >= 2)
    found = relations.select("id", placed.alias("m"), "tags").mapInArrow(run, f"id long, outers array<{LINE}>, inners array<{LINE}>, m array<struct<role:string,pts:{LINE}>>, tags {TAGS}")
    of = lambda k: F.transform(F.filter("m", lambda m: m["role"] == k), lambda m: m["pts"])
    has_outer = F.exists("m", lambda m: m["role"] == "outer")
    kind = F.when(F.size("outers") > 1, "MultiPolygon").when(F.size("outers") == 1, "Polygon").otherwise("Empty")
    lines = F.when(~has_outer, F.concat(of("other"), of("inner"))).otherwise(F.array().cast(f"array<{LINE}>"))
    return found.select("id", kind.alias("kind"), F.array().cast(LINE).alias("pts"), lines.alias("lines"), "outers", "inners", has_outer.alias("area"), "tags")


def document_features(nodes: DataFrame, ways: DataFrame, relations: DataFrame) -> DataFrame:
    """(type, id, value) of a document's elements as ``sources.xml`` reads them, from the coordinates in it.

    A way of fewer than two points has no geometry, nor has a relation without members that are lines.
    """
    none = F.array().cast(f"array<{LINE}>")
    shape = lambda df: geo.geojson(*[F.col(c) for c in ("kind", "pts", "outers", "inners")])
    n = nodes.select("id", "tags", F.lit("Point").alias("kind"), F.array(geo.point("lon", "lat")).alias("pts"), none.alias("outers"), none.alias("inners"))
    w = ways.select("id", "tags", geo.line_kind("pts").alias("kind"), "pts", F.when(geo.is_closed("pts"), F.array("pts")).otherwise(none).alias("outers"), none.alias("inners"))
    r = inline_relations(relations)
    line = F.when(F.size("pts") >= 2, shape(w))
    relation = F.when(F.col("area"), shape(r)).otherwise(geo.multi_line_geojson(F.col("lines")))
    parts = [("node", n, shape(n)), ("way", w, line), ("relation", r, relation)]
    rows = [df.select(F.lit(t).alias("type"), "id", _feature(t, F.col("tags"), g, named=False).alias("value")) for t, df, g in parts]
    return rows[0].union(rows[1]).union(rows[2])


# What the two kinds of document begin and end with.
KML_BEGIN, KML_END = '<?xml version="1.0" encoding="UTF-8"?>\n<kml xmlns="http://www.opengis.net/kml/2.2">\n<Document>', "</Document>\n</kml>"
WFS_BEGIN = '<wfs:FeatureCollection xmlns:wfs="http://www.opengis.net/wfs/2.0" xmlns:gml="http://www.opengis.net/gml/3.2" xmlns:osm="https://www.openstreetmap.org/" gml:id="elements">'
WFS_END = "</wfs:FeatureCollection>"


def kml_placemarks(shapes: DataFrame, kind: str) -> DataFrame:
    """(id, value): a Placemark for each shape (id, kind, pts, outers, inners) of elements of one type; empty shapes have none."""
    geometry = geo.kml(*[F.col(c) for c in ("kind", "pts", "outers", "inners")])
    return shapes.where(geometry.isNotNull()).select("id", F.concat(F.lit(f"<Placemark><name>{kind} "), F.col("id").cast("string"), F.lit("</name>"), geometry, F.lit("</Placemark>")).alias("value"))


def gml_members(shapes: DataFrame, kind: str, tags: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """(id, value): a member of a feature collection for each shape, with its tags (id, seq, k, v) and, of relations, members (rel_id, seq, type, ref, role)."""
    safe = lambda c: escaped(c, XML)
    geometry = geo.gml(*[F.col(c) for c in ("kind", "pts", "outers", "inners")])
    rows = _with_tags(shapes, tags)
    listed = F.lit("")
    if members is not None:
        lists = members.groupBy(F.col("rel_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("seq", "type", "ref", "role"))).alias("members"))
        rows = rows.join(lists, "id", "left")
        listed = F.coalesce(F.array_join(F.transform("members", lambda m: F.concat(F.lit('<osm:member type="'), m["type"], F.lit('" ref="'), m["ref"].cast("string"), F.lit('" role="'), safe(m["role"]), F.lit('"/>'))), ""), F.lit(""))
    tagged = F.array_join(F.transform("tags", lambda t: F.concat(F.lit('<osm:tag key="'), safe(t["k"]), F.lit('" value="'), safe(t["v"]), F.lit('"/>'))), "")
    shape = F.coalesce(F.concat(F.lit("<osm:geometry>"), geometry, F.lit("</osm:geometry>")), F.lit(""))
    head = F.concat(F.lit(f'<wfs:member><osm:{kind} gml:id="{kind}.'), F.col("id").cast("string"), F.lit('">'))
    return rows.select("id", F.concat(head, shape, tagged, listed, F.lit(f"</osm:{kind}></wfs:member>")).alias("value"))


def write_kml(placemarks: DataFrame, path: str) -> None:
    framed(placemarks, KML_BEGIN, "", KML_END).write.text(path)


def write_gml(members: DataFrame, path: str) -> None:
    framed(members, WFS_BEGIN, "", WFS_END).write.text(path)
