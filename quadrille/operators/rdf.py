"""Elements as triples: (s, p, o, o_kind, o_datatype)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.functions import geof, tiles
from quadrille.functions.text import LITERAL, escaped, fixed7, percent_encoded, wikidata_entity, wikipedia_triples
from quadrille.operators.select import TYPES, all_elements, all_tags, nodes_in, relations_in, tag_condition, ways_in
from quadrille.sources.elements import Elements

# Names of the vocabularies used.
TYPE, IDENTIFIER, LAT, LONG, SUBJECT, SEE_ALSO = "rdf:type", "dcterms:identifier", "geo:lat", "geo:long", "dc:subject", "rdfs:seeAlso"
GEOMETRY, WKT_LITERAL = "locn:geometry", "gsp:wktLiteral"
ACTIVITY, ENDED, AGENT, COMMENT = "prov:Activity", "prov:endedAtTime", "prov:wasAssociatedWith", "rdfs:comment"
PREFIXES = {
    "rdf:": "http://www.w3.org/1999/02/22-rdf-syntax-ns#",
    "rdfs:": "http://www.w3.org/2000/01/rdf-schema#",
    "dc:": "http://purl.org/dc/elements/1.1/",
    "dcterms:": "http://purl.org/dc/terms/",
    "geo:": "http://www.w3.org/2003/01/geo/wgs84_pos#",
    "prov:": "http://www.w3.org/ns/prov#",
    "locn:": "http://www.w3.org/ns/locn#",
    "gsp:": "http://www.opengis.net/ont/geosparql#",
    "dcat:": "http://www.w3.org/ns/dcat#",
    "foaf:": "http://xmlns.com/foaf/0.1/",
    "owl:": "http://www.w3.org/2002/07/owl#",
    "spatial:": "http://geovocab.org/spatial#",
    "skos:": "http://www.w3.org/2004/02/skos/core#",
    "xsd:": "http://www.w3.org/2001/XMLSchema#",
}
COLUMNS = ("s", "p", "o", "o_kind", "o_datatype")


def subject(kind: Column, id: Column) -> Column:
    return F.concat(F.lit("/osm/"), kind, F.lit("/"), id.cast("string"), F.lit("#id"))


def _triples(df: DataFrame, s: Column, *rows: tuple[Column | str, Column, str, str | None]) -> DataFrame:
    """A branch of triples for each predicate, so that a constant predicate in a pattern prunes all others; null objects are left out."""
    parts = [df.select(s.alias("s"), (F.lit(p) if isinstance(p, str) else p).alias("p"), o.cast("string").alias("o"), F.lit(kind).alias("o_kind"), F.lit(datatype).cast("string").alias("o_datatype")).where("o is not null") for p, o, kind, datatype in rows]
    return reduce(DataFrame.union, parts)


def element_triples(e: Elements) -> DataFrame:
    """Type, identifier, coordinates, tags (as predicate and as subject concept) and members of all elements, each once.

    An element has one type, identifier and place; only tags and members may repeat.
    """
    named = all_elements(e).withColumn("s", subject(F.col("type"), F.col("id")))
    out = _triples(named, F.col("s"), (TYPE, F.concat(F.lit("osm:"), F.initcap("type")), "iri", None), (IDENTIFIER, F.col("id"), "literal", None))
    out = out.union(_triples(e.nodes, subject(F.lit("node"), F.col("id")), (LAT, fixed7(F.col("lat7")), "literal", "xsd:decimal"), (LONG, fixed7(F.col("lon7")), "literal", "xsd:decimal")))
    tagged = all_tags(e).withColumn("s", subject(F.col("type"), F.col("id")))
    out = out.union(_triples(tagged, F.col("s"), (F.concat(F.lit("/tag/"), F.col("k")), F.col("v"), "literal", None), (SUBJECT, concept(F.col("k"), F.col("v")), "iri", None)).distinct())
    return out.union(_triples(e.relation_members, subject(F.lit("relation"), F.col("rel_id")), (SEE_ALSO, subject(F.col("type"), F.col("ref")), "iri", None)).distinct())


def concept(k: Column, v: Column) -> Column:
    return F.concat(F.lit("/tag/"), percent_encoded(k), F.lit("="), percent_encoded(v), F.lit("#concept"))


def way_texts(e: Elements, ways: DataFrame) -> DataFrame:
    """(id, wkt) of ways (id): their own coordinates with seven decimals. A way whose first and last node are the same is a polygon, however short."""
    refs = e.way_nodes.join(ways.select(F.col("id").alias("way_id")), "way_id", "left_semi")
    text = F.concat(fixed7(F.col("lon7")), F.lit(" "), fixed7(F.col("lat7")))
    placed = refs.join(e.nodes.select(F.col("id").alias("node_id"), text.alias("text")), "node_id", "left")
    seen = placed.groupBy(F.col("way_id").alias("id")).agg(F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("seq", "text")))).alias("pts"), F.min_by("node_id", "seq").alias("first"), F.max_by("node_id", "seq").alias("last"))
    points = F.array_join(F.transform("pts", lambda x: x["text"]), ", ")
    wkt = F.when(F.col("first") == F.col("last"), F.concat(F.lit("POLYGON(("), points, F.lit("))"))).otherwise(F.concat(F.lit("LINESTRING("), points, F.lit(")")))
    return seen.where(F.size("pts") > 0).select("id", wkt.alias("wkt"))


def geometry_triples(e: Elements, chosen: DataFrame | None = None) -> DataFrame:
    """Geometry of tagged nodes and ways as WKT literals, of all or of ``chosen`` (type, id); relations have none."""

    def tagged(kind: str, elements: DataFrame, tags: DataFrame) -> DataFrame:
        found = elements.join(tags, "id", "left_semi")
        return found if chosen is None else found.join(chosen.where(F.col("type") == kind), "id", "left_semi")

    point = F.concat(F.lit("POINT("), fixed7(F.col("lon7")), F.lit(" "), fixed7(F.col("lat7")), F.lit(")"))
    nodes = tagged("node", e.nodes, e.node_tags).select("id", point.alias("wkt"))
    ways = way_texts(e, tagged("way", e.ways, e.way_tags))
    out = [_triples(df, subject(F.lit(kind), F.col("id")), (GEOMETRY, F.col("wkt"), "literal", WKT_LITERAL)) for kind, df in (("node", nodes), ("way", ways))]
    return out[0].union(out[1])


def feature_triples(e: Elements, chosen: DataFrame | None = None) -> DataFrame:
    """What a document of features says: each tag as a subject, and the geometry; of all elements or of ``chosen`` (type, id)."""
    tagged = all_tags(e) if chosen is None else all_tags(e).join(chosen, ["type", "id"], "left_semi")
    subjects = _triples(tagged, subject(F.col("type"), F.col("id")), (SUBJECT, concept(F.col("k"), F.col("v")), "iri", None)).distinct()
    return subjects.union(geometry_triples(e, chosen))


def box_features(e: Elements, bbox, tag: str | None = None, kind: str = "nwr") -> DataFrame:
    """(type, id) of the elements in a box, those with a tag (``key`` or ``key=value``) where one is given."""
    parts = {"node": nodes_in(e, bbox), "way": ways_in(e, bbox), "relation": relations_in(e, bbox)}
    found = reduce(DataFrame.union, [df.select(F.lit(t).alias("type"), "id") for t, df in parts.items() if t[0] in kind])
    return found if not tag else found.join(all_tags(e).where(tag_condition(tag)), ["type", "id"], "left_semi")


def changeset_triples(changesets: DataFrame) -> DataFrame:
    """Changesets (id, created_at, user_id, comment) as activities."""
    s = F.concat(F.lit("/changeset/"), F.col("id").cast("string"))
    ended = F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return _triples(changesets, s, (TYPE, F.lit(ACTIVITY), "iri", None), (ENDED, ended, "literal", "xsd:dateTime"), (AGENT, F.concat(F.lit("/user/"), F.col("user_id").cast("string")), "iri", None), (COMMENT, F.col("comment"), "literal", None))


def activity_triples(changesets: DataFrame) -> DataFrame:
    """Changesets (id, created_at, user_id, comment) as activities of an agent, who is a blank node of each changeset."""
    s = F.concat(F.lit("/changeset/"), F.col("id").cast("string"))
    agent = F.concat(F.lit("_:agent"), F.col("id").cast("string"))
    ended = F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    own = _triples(changesets, s, (TYPE, F.lit(ACTIVITY), "iri", None), (ENDED, ended, "literal", "xsd:dateTime"), (AGENT, agent, "blank", None), (COMMENT, F.col("comment"), "literal", None))
    user = F.col("user_id").cast("string")
    home = F.concat(F.lit("https://www.openstreetmap.org/user/"), percent_encoded(user))
    return own.union(_triples(changesets, agent, (TYPE, F.lit("prov:Agent"), "iri", None), ("foaf:accountName", user, "literal", None), ("foaf:accountServiceHomepage", F.lit("https://www.openstreetmap.org"), "iri", None), ("foaf:homepage", home, "iri", None)))


def version_triples(elements: DataFrame) -> DataFrame:
    """Versions of elements (type, id, version, changeset) as sources of their own; those without a version have none."""
    at = F.concat(F.lit("https://api.openstreetmap.org/api/0.6/"), F.col("type"), F.lit("/"), F.col("id").cast("string"), F.lit("/"), F.col("version").cast("string"))
    return _triples(elements.where("version IS NOT NULL"), at, ("prov:value", F.col("version"), "literal", None), ("prov:wasGeneratedBy", F.concat(F.lit("/changeset/"), F.col("changeset").cast("string")), "iri", None))


def place_triples(places: DataFrame) -> DataFrame:
    """Places (type, id, name, class, kind, lon, lat) of a search, each with the element that it is."""
    s = subject(F.col("type"), F.col("id"))
    return _triples(places, s, (TYPE, F.lit("spatial:Feature"), "iri", None), ("rdfs:label", F.col("name"), "literal", None), (SUBJECT, concept(F.col("class"), F.col("kind")), "iri", None), (LAT, F.col("lat"), "literal", "xsd:decimal"), (LONG, F.col("lon"), "literal", "xsd:decimal"))


def link_triples(tags: DataFrame) -> DataFrame:
    """Articles, data items and the English label of tags (type, id, k, v)."""
    s = subject(F.col("type"), F.col("id"))
    article = wikipedia_triples(F.col("v"))
    out = _triples(tags.where("k = 'wikipedia'"), s, ("foaf:page", article["page"], "iri", None), ("owl:sameAs", article["same_as"], "iri", None))
    out = out.union(_triples(tags.where("k = 'wikidata'"), s, ("owl:sameAs", wikidata_entity(F.col("v")), "iri", None)))
    return out.union(_triples(tags.where("k = 'name:en'"), s, ("rdfs:label", F.col("v"), "literal", None)))


def document_triples(documents: DataFrame, agent: str) -> DataFrame:
    """Where documents (url, source, generated, west, south, east, north) come from; without a box they have no place.

    The time is a column, so that the triples are the same each time. The place is a blank node.
    """
    url, place = F.col("url"), F.concat(F.lit("_:box"), F.md5("url"))
    time = F.date_format("generated", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    boxed = documents.where("west IS NOT NULL AND south IS NOT NULL AND east IS NOT NULL AND north IS NOT NULL")
    out = _triples(documents, url, ("prov:hadPrimarySource", F.col("source"), "iri", None), ("prov:generatedAtTime", time, "literal", "xsd:dateTime"), ("prov:wasAttributedTo", F.lit(agent), "iri", None))
    out = out.union(_triples(boxed, url, ("dcterms:spatial", place, "blank", None)))
    wkt = geof.box_wkt(*[F.col(c).cast("double") for c in ("west", "south", "east", "north")])
    return out.union(_triples(boxed, place, (TYPE, F.lit("dcterms:Location"), "iri", None), ("dcat:bbox", wkt, "literal", WKT_LITERAL)))


def tile_triples(tiles_: DataFrame, layer: str, source: str, licences: list[str]) -> DataFrame:
    """Tiles (z, x, y) as images of a place: title, resolution, licences and footprint."""
    z, x, y = F.col("z"), F.col("x"), F.col("y")
    name = F.concat_ws("/", z, x, y)
    s, place = F.concat(F.lit(f"/tile/{layer}/"), name), F.concat(F.lit("_:tile-"), F.concat_ws("-", z, x, y))
    box = tiles.tile_bbox(z, x, y)
    wkt = geof.box_wkt(box["west"], box["south"], box["east"], box["north"])
    out = _triples(tiles_, s, (TYPE, F.lit("dcat:Distribution"), "iri", None), (TYPE, F.lit("foaf:Image"), "iri", None), ("dcterms:title", F.concat(F.lit(f"{layer} tile "), name), "literal", None), ("dcat:spatialResolutionInMeters", F.round(tiles.ground_resolution(z, y), 6), "literal", "xsd:decimal"), ("prov:hadPrimarySource", F.lit(source), "iri", None), *[("dcterms:license", F.lit(x), "iri", None) for x in licences], ("dcterms:spatial", place, "blank", None))
    return out.union(_triples(tiles_, place, (TYPE, F.lit("dcterms:Location"), "iri", None), ("dcat:bbox", wkt, "literal", WKT_LITERAL)))


def key_triples(keys: DataFrame) -> DataFrame:
    """Keys (k, uses) of an index as concepts of one scheme."""
    s = F.concat(F.lit("/tag/"), percent_encoded(F.col("k")), F.lit("#concept"))
    return _triples(keys, s, (TYPE, F.lit("skos:Concept"), "iri", None), ("skos:notation", F.col("k"), "literal", None), ("skos:inScheme", F.lit("/tag/#scheme"), "iri", None))


def merged(*graphs: DataFrame) -> DataFrame:
    """The triples of several graphs as one set."""
    out = graphs[0].select(*COLUMNS)
    for g in graphs[1:]:
        out = out.union(g.select(*COLUMNS))
    return out.distinct()


def ntriples(triples: DataFrame, base: str) -> DataFrame:
    """Lines of N-Triples (column value); paths are made absolute with ``base``, the vocabulary's own names too."""

    def iri(c: Column) -> Column:
        full = F.when(c.startswith("/"), F.concat(F.lit(base), F.replace(c, F.lit(" "), F.lit("%20"))))
        for prefix, name in {**PREFIXES, "osm:": f"{base}/vocab#"}.items():
            full = full.when(c.startswith(prefix), F.concat(F.lit(name), F.substring(c, F.lit(len(prefix) + 1), F.length(c))))
        return F.when(c.startswith("_:"), c).otherwise(F.concat(F.lit("<"), full.otherwise(c), F.lit(">")))

    lang = F.concat(F.lit("@"), F.col("o_lang")) if "o_lang" in triples.columns else F.lit(None).cast("string")
    literal = F.concat(F.lit('"'), escaped(F.col("o"), LITERAL), F.lit('"'), F.coalesce(lang, F.concat(F.lit("^^"), iri(F.col("o_datatype"))), F.lit("")))
    return triples.select(F.concat_ws(" ", iri(F.col("s")), iri(F.col("p")), F.when(F.col("o_kind") == "literal", literal).otherwise(iri(F.col("o"))), F.lit(".")).alias("value"))


__all__ = ["TYPES", "box_features", "changeset_triples", "concept", "element_triples", "feature_triples", "geometry_triples", "merged", "ntriples", "subject"]
