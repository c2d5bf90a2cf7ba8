"""What an element needs: full expansion, recursion and completeness."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrille.sources.elements import Elements
from quadrille.tables import materialize


def _refs(e: Elements) -> DataFrame:
    """(type, id, to_type, to_id): what each way and relation refers to directly."""
    ways = e.way_nodes.select(F.lit("way").alias("type"), F.col("way_id").alias("id"), F.lit("node").alias("to_type"), F.col("node_id").alias("to_id"))
    members = e.relation_members.select(F.lit("relation").alias("type"), F.col("rel_id").alias("id"), F.col("type").alias("to_type"), F.col("ref").alias("to_id"))
    return ways.union(members)


def way_full(e: Elements, ways: DataFrame) -> DataFrame:
    """(way_id, node_id) of each way's nodes, once each, for ways (column id) that have all of them."""
    refs = e.way_nodes.join(ways.select(F.col("id").alias("way_id")), "way_id", "left_semi").select("way_id", "node_id").distinct()
    there = e.nodes.select(F.col("id").alias("node_id")).distinct().withColumn("there", F.lit(True))
    lacking = F.count_if(F.col("there").isNull()).over(Window.partitionBy("way_id"))
    return refs.join(there, "node_id", "left").withColumn("lacking", lacking).where("lacking = 0").select("way_id", "node_id")


def relation_full(e: Elements, relations: DataFrame) -> DataFrame:
    """(rel_id, type, id): members of each relation (column id), and the nodes of its member ways, once each.

    Member relations are listed, not opened; a relation is no member of itself.
    """
    members = e.relation_members.join(relations.select(F.col("id").alias("rel_id")), "rel_id", "left_semi").where(~((F.col("type") == "relation") & (F.col("ref") == F.col("rel_id"))))
    direct = members.select("rel_id", "type", F.col("ref").alias("id"))
    inner = members.where("type = 'way'").join(e.way_nodes, F.col("ref") == F.col("way_id")).select("rel_id", F.lit("node").alias("type"), F.col("node_id").alias("id"))
    return direct.union(inner).distinct()


def recurse_down(e: Elements, start: DataFrame, depth: int | None = None) -> DataFrame:
    """(type, id) of ``start`` and all that it refers to.

    ``depth`` bounds the levels of relations that are opened; without it the
    frontier moves until nothing new is met, so cycles end. Each level is a join
    of the frontier with the references, and is written once.
    """
    refs = _refs(e)
    members = refs.where("type = 'relation'")
    seen = frontier = materialize(start.select("type", "id").distinct())
    level = 0
    while depth is None or level < depth:
        step = members.join(frontier, ["type", "id"], "left_semi").select(F.col("to_type").alias("type"), F.col("to_id").alias("id")).distinct()
        frontier = materialize(step.join(seen, ["type", "id"], "left_anti"))
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
        level += 1
    nodes = refs.where("type = 'way'").join(seen, ["type", "id"], "left_semi").select(F.col("to_type").alias("type"), F.col("to_id").alias("id"))
    return seen.union(nodes).distinct()


def incomplete_ways(e: Elements, nodes: DataFrame) -> DataFrame:
    """(id) of ways that refer to a node which ``nodes`` (column id) lacks."""
    return e.way_nodes.join(nodes.select(F.col("id").alias("node_id")), "node_id", "left_anti").select(F.col("way_id").alias("id")).distinct()


def incomplete_relations(e: Elements, nodes: DataFrame, bad_ways: DataFrame) -> DataFrame:
    """(id) of relations with a member that is missing, or a way of ``bad_ways``.

    A member relation must exist; its own completeness doesn't matter.
    """
    members = e.relation_members
    there = nodes.select(F.lit("node").alias("type"), F.col("id").alias("ref")).union(e.ways.select(F.lit("way"), "id")).union(e.relations.select(F.lit("relation"), "id"))
    missing = members.join(there, ["type", "ref"], "left_anti").select("rel_id")
    broken = members.where("type = 'way'").join(bad_ways.select(F.col("id").alias("ref")), "ref", "left_semi").select("rel_id")
    return missing.union(broken).select(F.col("rel_id").alias("id")).distinct()


def first_region(regions: list[DataFrame]) -> DataFrame:
    """(id, region): for each id the first of the tables (column id), in order, that has it."""
    parts = [df.select("id", F.lit(i).alias("region")) for i, df in enumerate(regions)]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out.groupBy("id").agg(F.min("region").alias("region"))


def block_index(ids: DataFrame, rows: int) -> DataFrame:
    """(block, min_id, max_id, n) of blocks that each cover ``rows`` consecutive id values (column id)."""
    return ids.groupBy(F.floor(F.col("id") / rows).alias("block")).agg(F.min("id").alias("min_id"), F.max("id").alias("max_id"), F.count("*").alias("n"))


def block_lookup(index: DataFrame, wanted: DataFrame, rows: int) -> DataFrame:
    """(id, block): the block whose range holds each wanted id (column id), null without one."""
    guess = wanted.withColumn("block", F.floor(F.col("id") / rows))
    fits = F.col("id").between(F.col("min_id"), F.col("max_id"))
    return guess.join(index, "block", "left").select("id", F.when(fits, F.col("block")).alias("block"))


def _wanted(e: Elements, start: DataFrame) -> DataFrame:
    """(of_type, of_id, type, id): the direct references of ``start`` (type, id), once each; a relation is no member of itself."""
    refs = _refs(e).select(F.col("type").alias("of_type"), F.col("id").alias("of_id"), F.col("to_type").alias("type"), F.col("to_id").alias("id"))
    own = refs.join(start.select(F.col("type").alias("of_type"), F.col("id").alias("of_id")), ["of_type", "of_id"], "left_semi")
    return own.where("NOT (of_type = 'relation' AND type = 'relation' AND of_id = id)").distinct()


def _complete_ways(e: Elements, ways: DataFrame) -> DataFrame:
    """(id) of ``ways`` (id) that exist, have nodes and find all of them: as many found as wanted."""
    refs = e.way_nodes.join(ways.select(F.col("id").alias("way_id")), "way_id", "left_semi").select("way_id", "node_id").distinct()
    there = e.nodes.select(F.col("id").alias("node_id"), F.lit(1).alias("found"))
    counted = refs.join(there, "node_id", "left").groupBy(F.col("way_id").alias("id")).agg(F.count("*").alias("wanted"), F.count("found").alias("found"))
    return counted.where("wanted = found").select("id").join(e.ways, "id", "left_semi")


def complete(e: Elements, start: DataFrame) -> DataFrame:
    """(type, id) of ``start`` (type, id) that can be answered completely.

    A node must exist. A way must exist and find all of its nodes. A relation must exist and find every direct member:
    member ways with all of their nodes, member relations without theirs. What is missing is counted from the references
    up: found against wanted, first for ways, then for relations.
    """
    start = start.select("type", "id").distinct()
    of = lambda t: start.where(F.col("type") == t).select("id")
    relations = of("relation").join(e.relations, "id", "left_semi")
    wanted = _wanted(e, relations.select(F.lit("relation").alias("type"), "id"))
    member = lambda t: wanted.where(F.col("type") == t).select("id").distinct()
    whole = _complete_ways(e, of("way").union(member("way")).distinct())
    nodes = of("node").join(e.nodes, "id", "left_semi")
    there = member("node").join(e.nodes, "id", "left_semi").select(F.lit("node").alias("type"), "id")
    there = there.union(whole.select(F.lit("way"), "id")).union(member("relation").join(e.relations, "id", "left_semi").select(F.lit("relation"), "id"))
    counted = wanted.join(there.withColumn("found", F.lit(1)), ["type", "id"], "left").groupBy(F.col("of_id").alias("id")).agg(F.count("*").alias("wanted"), F.count("found").alias("found"))
    lacking = counted.where("wanted > found")  # a relation without members lacks none
    fine = relations.join(lacking, "id", "left_anti")
    return nodes.select(F.lit("node").alias("type"), "id").union(whole.join(of("way"), "id", "left_semi").select(F.lit("way"), "id")).union(fine.select(F.lit("relation"), "id"))


def _answers(e: Elements, fine: DataFrame) -> DataFrame:
    """(of_type, of_id, type, id): all that each of ``fine`` (type, id) needs, itself included, once each."""
    wanted = _wanted(e, fine)
    inner = wanted.where("of_type = 'relation' AND type = 'way'").join(e.way_nodes, F.col("id") == F.col("way_id"))
    own = fine.select(F.col("type").alias("of_type"), F.col("id").alias("of_id"), "type", "id")
    return own.union(wanted).union(inner.select("of_type", "of_id", F.lit("node"), "node_id")).distinct()


def full_complete(e: Elements, start: DataFrame) -> DataFrame:
    """(of_type, of_id, type, id): each answerable element of ``start`` (type, id) with all it needs, itself included, once each.

    An element that isn't found completely gives no row at all.
    """
    return _answers(e, materialize(complete(e, start)))


def first_complete_region(regions: list[Elements], start: DataFrame) -> DataFrame:
    """(type, id, region): for each of ``start`` (type, id) the number of the first region that answers it completely, null without one."""
    found = [complete(e, start).withColumn("region", F.lit(i)) for i, e in enumerate(regions)]
    best = reduce(DataFrame.union, found).groupBy("type", "id").agg(F.min("region").alias("region"))
    return start.select("type", "id").distinct().join(best, ["type", "id"], "left").select("type", "id", "region")


def fallback_full(regions: list[Elements], start: DataFrame) -> DataFrame:
    """(of_type, of_id, region, type, id): the full answer of the first region that has one."""
    chosen = materialize(first_complete_region(regions, start).where("region IS NOT NULL"))
    parts = [_answers(e, chosen.where(F.col("region") == i).select("type", "id")).withColumn("region", F.lit(i)) for i, e in enumerate(regions)]
    return reduce(DataFrame.union, parts).select("of_type", "of_id", "region", "type", "id")
