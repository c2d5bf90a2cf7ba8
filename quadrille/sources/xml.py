"""Element, place and changeset documents in XML, read by Spark's XML source.

Schemas are explicit: inference would read a single ``tag`` as a struct instead
of a list. Attributes get the prefix ``_``. Rows with broken coordinates keep
null ones; documents are not validated against each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.functions.geo import point

# The attributes of the document formats.
INFO = "_version int, _changeset long, _timestamp timestamp, _user string, _uid long"
TAG = "tag array<struct<_k:string,_v:string>>"
SCHEMAS = {
    "node": f"_id long, _lat double, _lon double, {INFO}, {TAG}",
    "way": f"_id long, {INFO}, nd array<struct<_ref:long,_lat:double,_lon:double>>, {TAG}",
    "relation": f"_id long, {INFO}, member array<struct<_type:string,_ref:long,_role:string,nd:array<struct<_lat:double,_lon:double>>>>, {TAG}",
    "place": "_lat double, _lon double, _osm_type string, _osm_id long, _display_name string, _class string, _type string, _importance double",
    "changeset": f"_id long, _created_at timestamp, _closed_at timestamp, _user string, _uid long, _changes_count long, _min_lat double, _min_lon double, _max_lat double, _max_lon double, {TAG}",
}


def read(spark: SparkSession, path: str, row: str) -> DataFrame:
    """Rows of one element name from all documents at ``path``; files are split and read in parallel."""
    return spark.read.format("xml").option("rowTag", row).option("attributePrefix", "_").schema(SCHEMAS[row]).load(path)


def _tags() -> Column:
    return F.coalesce(F.transform("tag", lambda t: F.struct(t["_k"].alias("k"), t["_v"].alias("v"))), F.array().cast("array<struct<k:string,v:string>>")).alias("tags")


def _info() -> list[Column]:
    return [F.col("_version").alias("version"), F.col("_timestamp").alias("ts"), F.col("_changeset").alias("changeset"), F.col("_uid").alias("uid"), F.col("_user").alias("user")]


def nodes(spark: SparkSession, path: str) -> DataFrame:
    """(id, lat7, lon7, lat, lon, info, tags); nodes without coordinates are left out."""
    whole = lambda c: F.round(F.col(c) * 1e7).cast("long")
    found = read(spark, path, "node").where("_id is not null and _lat is not null and _lon is not null")
    return found.select(F.col("_id").alias("id"), whole("_lat").alias("lat7"), whole("_lon").alias("lon7"), F.col("_lat").alias("lat"), F.col("_lon").alias("lon"), *_info(), _tags())


def ways(spark: SparkSession, path: str) -> DataFrame:
    """(id, refs, pts, info, tags); ``pts`` holds the coordinates that stand in the document itself."""
    inline = F.transform(F.filter("nd", lambda n: n["_lat"].isNotNull() & n["_lon"].isNotNull()), lambda n: point(n["_lon"], n["_lat"]))
    return read(spark, path, "way").select(F.col("_id").alias("id"), F.transform("nd", lambda n: n["_ref"]).alias("refs"), inline.alias("pts"), *_info(), _tags())


def relations(spark: SparkSession, path: str) -> DataFrame:
    """(id, members, info, tags); a member has its type, ref, role and the coordinates in the document."""
    member = lambda m: F.struct(m["_type"].alias("type"), m["_ref"].alias("ref"), m["_role"].alias("role"), F.transform(m["nd"], lambda n: point(n["_lon"], n["_lat"])).alias("pts"))
    return read(spark, path, "relation").select(F.col("_id").alias("id"), F.transform("member", member).alias("members"), *_info(), _tags())


def places(spark: SparkSession, path: str) -> DataFrame:
    """(type, id, name, class, kind, importance, lon, lat) of search answers with a position."""
    found = read(spark, path, "place").where("_lat is not null and _lon is not null")
    return found.selectExpr("_osm_type AS type", "_osm_id AS id", "_display_name AS name", "_class AS class", "_type AS kind", "_importance AS importance", "_lon AS lon", "_lat AS lat")


def changesets(spark: SparkSession, path: str) -> DataFrame:
    """(id, created_at, closed_at, user, uid, changes, bounds, tags)."""
    bounds = F.when(F.col("_min_lat").isNotNull(), F.struct(F.col("_min_lon").alias("west"), F.col("_min_lat").alias("south"), F.col("_max_lon").alias("east"), F.col("_max_lat").alias("north")))
    return read(spark, path, "changeset").select(F.col("_id").alias("id"), F.col("_created_at").alias("created_at"), F.col("_closed_at").alias("closed_at"), F.col("_user").alias("user"), F.col("_uid").alias("uid"), F.col("_changes_count").alias("changes"), bounds.alias("bounds"), _tags())


def way_nodes(ways: DataFrame) -> DataFrame:
    """(way_id, seq, node_id) from ``ways``."""
    return ways.select(F.col("id").alias("way_id"), F.posexplode("refs").alias("seq", "node_id")).select("way_id", F.col("seq").cast("long").alias("seq"), "node_id")


def relation_members(relations: DataFrame) -> DataFrame:
    """(rel_id, seq, type, ref, role) from ``relations``."""
    return relations.select(F.col("id").alias("rel_id"), F.posexplode("members").alias("seq", "m")).select("rel_id", F.col("seq").cast("long").alias("seq"), "m.type", "m.ref", "m.role")


def tags(elements: DataFrame) -> DataFrame:
    """(id, seq, k, v) in document order."""
    return elements.select("id", F.posexplode("tags").alias("seq", "t")).select("id", "seq", "t.k", "t.v")
