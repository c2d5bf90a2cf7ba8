"""Geometry of elements: ordered coordinates, rings stitched from ways, polygons with holes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.functions.geo import is_closed, line_kind, point, ring_area
from quadrille.sources.elements import Elements

# Relations of these types are areas.
AREA_TYPES = ("multipolygon", "boundary")


def way_lines(e: Elements, ways: DataFrame | None = None) -> DataFrame:
    """(id, pts) of ways: coordinates in order; unknown nodes are left out, ways without a known one too."""
    refs = e.way_nodes if ways is None else e.way_nodes.join(ways.select(F.col("id").alias("way_id")), "way_id", "left_semi")
    placed = refs.join(e.nodes.select(F.col("id").alias("node_id"), point("lon", "lat").alias("p")), "node_id")
    ordered = F.array_sort(F.collect_list(F.struct("seq", "p")))
    return placed.groupBy(F.col("way_id").alias("id")).agg(F.transform(ordered, lambda x: x["p"]).alias("pts"))


def way_geometries(e: Elements) -> DataFrame:
    """(id, kind, pts, outers, inners) of ways."""
    none = F.array().cast("array<array<struct<lon:double,lat:double>>>")
    return way_lines(e).select("id", line_kind("pts").alias("kind"), "pts", F.when(is_closed("pts"), F.array("pts")).otherwise(none).alias("outers"), none.alias("inners"))


def stitch(segments: list[list[tuple[float, float]]]) -> list[list[tuple[float, float]]]:
    """Rings from ways, greedily and in order.

    A ring starts with the first segment left and grows at its end only, by the
    first segment that begins there, or ends there and is turned round. It ends
    when it is closed or nothing fits; open ones are closed if that gives at
    least four points. Segments are found by their end points, so work grows
    with the number of segments.
    """
    at: dict[tuple[float, float], list[int]] = {}
    for i, s in enumerate(segments):
        for end in {s[0], s[-1]}:
            at.setdefault(end, []).append(i)
    used, rings = [False] * len(segments), []
    heads = dict.fromkeys(at, 0)
    for first, segment in enumerate(segments):
        if used[first]:
            continue
        used[first] = True
        ring = list(segment)
        while not (len(ring) >= 4 and ring[0] == ring[-1]):
            end = ring[-1]
            waiting, head = at.get(end, []), heads.get(end, 0)
            while head < len(waiting) and used[waiting[head]]:
                head += 1
            heads[end] = head
            if head == len(waiting):
                break
            used[waiting[head]] = True
            more = segments[waiting[head]]
            ring += (more if more[0] == end else more[::-1])[1:]
        if len(ring) >= 3:
            if ring[0] != ring[-1]:
                ring.append(ring[0])
            if len(ring) >= 4:
                rings.append(ring)
    return rings


def relation_geometries(e: Elements, areas_only: bool = False) -> DataFrame:
    """(id, kind, pts, outers, inners) of relations with a geometry.

    Areas are stitched from their member ways; any other relation, and an area
    without an outer ring, is the line of its members' points in order.
    ``areas_only`` gives the relations that have an outer ring, and assembles no others.
    """
    types = e.relation_tags.where("k = 'type'").groupBy("id").agg(F.min_by("v", "seq").alias("type"))
    area = F.coalesce(F.col("type").isin(*AREA_TYPES), F.lit(False))
    wanted = e.relation_members
    if areas_only:
        wanted = wanted.join(types.where(area).select(F.col("id").alias("rel_id")), "rel_id", "left_semi")
    lines = way_lines(e)
    members = wanted.where("type = 'way'").join(lines.select(F.col("id").alias("ref"), "pts"), "ref").select("rel_id", "seq", "role", "pts")
    if not areas_only:
        nodes = wanted.where("type = 'node'").join(e.nodes.select(F.col("id").alias("ref"), F.array(point("lon", "lat")).alias("pts")), "ref")
        members = members.union(nodes.select("rel_id", "seq", F.lit("node").alias("role"), "pts"))
    members = members.groupBy(F.col("rel_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("seq", "role", "pts"))).alias("members"))
    typed = members.select("id", F.lit(True).alias("area"), "members") if areas_only else members.join(types, "id", "left").select("id", area.alias("area"), "members")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Only the order-dependent stitching runs here; each relation is a row."""
        for batch in batches:
            _, role, pts = batch.column(2).flatten().flatten()
            lon, lat = (c.to_numpy(zero_copy_only=False) for c in pts.flatten().flatten())
            roles, points = role.to_pylist(), list(zip(lon.tolist(), lat.tolist()))
            at = _ends(pts.value_lengths())
            of = _ends(batch.column(2).value_lengths())
            rings = [], []
            for area, first, last in zip(batch.column(1).to_pylist(), of, of[1:]):
                parts = [(roles[i], points[at[i] : at[i + 1]]) for i in range(first, last)] if area else []
                outers = stitch([p for r, p in parts if r not in ("inner", "node")])
                rings[0].append(outers)
                rings[1].append(stitch([p for r, p in parts if r == "inner"]) if outers else [])
            counts = np.diff(np.take(at, of))
            open_ = np.array([not r for r in rings[0]], dtype=bool)
            keep = np.repeat(open_, counts)
            lines = pa.ListArray.from_arrays(_ends(np.where(open_, counts, 0)), pa.StructArray.from_arrays([lon[keep], lat[keep]], ["lon", "lat"]))
            yield pa.RecordBatch.from_arrays([batch.column(0), lines, *[_ring_lists(r) for r in rings]], ["id", "pts", "outers", "inners"])

    line = "array<struct<lon:double,lat:double>>"
    found = typed.mapInArrow(run, f"id long, pts {line}, outers array<{line}>, inners array<{line}>")
    kind = F.when(F.size("outers") > 1, "MultiPolygon").when(F.size("outers") == 1, "Polygon").when(F.size("pts") > 1, "LineString").when(F.size("pts") == 1, "Point").otherwise("Empty")
    out = found.select("id", kind.alias("kind"), "pts", "outers", "inners")
    return out.where(F.size("outers") > 0) if areas_only else out


def _ends(lengths) -> np.ndarray:
    """Offsets of lists that have these lengths."""
    return np.concatenate([[0], np.cumsum(np.asarray(lengths, dtype=np.int64))]).astype(np.int32)


def _ring_lists(rings: list[list[list[tuple[float, float]]]]) -> pa.Array:
    """A list of rings for each relation as one array."""
    flat = [ring for r in rings for ring in r]
    points = np.array([p for ring in flat for p in ring], dtype=np.float64).reshape(-1, 2)
    items = pa.StructArray.from_arrays([np.ascontiguousarray(points[:, i]) for i in (0, 1)], ["lon", "lat"])
    return pa.ListArray.from_arrays(_ends([len(r) for r in rings]), pa.ListArray.from_arrays(_ends([len(r) for r in flat]), items))


def geometry_area(outers="outers", inners="inners"):
    """Square metres of outer rings less inner ones."""
    add = lambda c: F.aggregate(F.transform(c, ring_area), F.lit(0.0), lambda a, x: a + x)
    return add(outers) - add(inners)
