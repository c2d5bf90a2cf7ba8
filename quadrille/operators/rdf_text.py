"""Graphs as documents: Turtle in blocks of a subject each, and GeoJSON features."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.functions import geof
from quadrille.functions.text import LITERAL, escaped
from quadrille.operators.rdf import GEOMETRY, PREFIXES, TYPE, WKT_LITERAL
from quadrille.operators.solutions import framed
from quadrille.tables import materialize

#: How deep blank nodes are opened inside of each other, and what stands for those below.
DEPTH, DEEPER = 5, '"[...]"'


# Turtle -----------------------------------------------------------------------


def header(base: str) -> str:
    """The prefixes of a document; where documents are joined, each may have them again."""
    return "".join(f"@prefix {p} <{n}> .\n" for p, n in sorted({**PREFIXES, "osm:": f"{base}/vocab#"}.items()))


def _iri(c: Column, base: str) -> Column:
    """A prefixed name where the rest is plain enough, else the whole address."""
    names = {**PREFIXES, "osm:": f"{base}/vocab#"}
    prefix = F.regexp_extract(c, f"^({'|'.join(map(re.escape, names))})", 1)
    name = F.try_element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), prefix)
    rest = F.substring(c, F.length(prefix) + 1, F.length(c))
    out = F.when(rest.rlike("^[A-Za-z_][A-Za-z0-9_-]*$") & name.isNotNull(), c).otherwise(F.concat(F.lit("<"), name, rest, F.lit(">")))
    path = F.when(c.startswith("/"), F.concat(F.lit(base), c)).otherwise(c)
    safe = path
    for sign, code in ((" ", "%20"), ("<", "%3C"), (">", "%3E"), ('"', "%22"), ("{", "%7B"), ("}", "%7D"), ("|", "%7C"), ("^", "%5E"), ("`", "%60"), ("\\", "%5C")):
        safe = F.replace(safe, F.lit(sign), F.lit(code))
    return F.coalesce(out, F.when(c.startswith("_:"), c), F.concat(F.lit("<"), safe, F.lit(">")))


def turtle(triples: DataFrame, base: str) -> DataFrame:
    """(s, value): a block of Turtle for each subject of triples (s, p, o, o_kind, o_datatype, and o_lang where they have it).

    Types come first and are written ``a``; the objects of a predicate stand in a row, in order. A block needs ``header``.
    """
    lang = F.concat(F.lit("@"), F.col("o_lang")) if "o_lang" in triples.columns else F.lit(None).cast("string")
    mark = F.coalesce(lang, F.concat(F.lit("^^"), _iri(F.col("o_datatype"), base)), F.lit(""))
    literal = F.concat(F.lit('"'), escaped(F.col("o"), LITERAL), F.lit('"'), mark)
    terms = triples.select("s", "p", F.when(F.col("o_kind") == "literal", literal).otherwise(_iri(F.col("o"), base)).alias("o")).where("s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL")
    # All that follows is within a subject, so rows move once.
    terms = terms.repartition("s").distinct()
    objects = terms.groupBy("s", "p").agg(F.array_sort(F.collect_list("o")).alias("o"))
    verb = F.when(F.col("p") == TYPE, F.lit("a")).otherwise(_iri(F.col("p"), base))
    lines = objects.select("s", F.struct((F.col("p") != TYPE).alias("late"), F.col("p").alias("p"), F.concat(verb, F.lit(" "), F.array_join("o", ", ")).alias("line")).alias("l"))
    blocks = lines.groupBy("s").agg(F.array_sort(F.collect_list("l")).alias("l"))
    return blocks.select("s", F.concat(_iri(F.col("s"), base), F.lit(" "), F.array_join(F.transform("l", lambda x: x["line"]), " ;\n    "), F.lit(" .\n")).alias("value"))


def write_turtle(triples: DataFrame, path: str, base: str) -> None:
    """Text files of blocks in the order of subjects, each with the header; files can be joined in any order."""
    head = header(base)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = True
        for batch in batches:
            if first and batch.num_rows:
                first = False
                yield pa.RecordBatch.from_arrays([pa.array([head])], ["value"])
            yield batch

    turtle(triples, base).orderBy("s").select("value").mapInArrow(run, "value string").write.text(path)


# GeoJSON ----------------------------------------------------------------------


def _json(c: Column) -> Column:
    return F.regexp_extract(F.to_json(F.struct(c.alias("x"))), r'^\{"x":([\s\S]*)\}$', 1)


def _object(rows: DataFrame, key: str) -> DataFrame:
    """(key, json): an object of the members (key, p, json); of a name that occurs again the greatest value stays."""
    members = rows.groupBy(key, "p").agg(F.max("json").alias("json"))
    fields = members.select(key, F.struct("p", F.concat(_json(F.col("p")), F.lit(":"), F.col("json")).alias("field")).alias("f"))
    return fields.groupBy(key).agg(F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.collect_list("f")), lambda x: x["field"]), ","), F.lit("}")).alias("json"))


def geojson_of_triples(triples: DataFrame) -> DataFrame:
    """(s, value): a GeoJSON feature for each subject that is an address, of triples (s, p, o, o_kind, o_datatype).

    Its WKT literal becomes the geometry (of several the greatest text; one that isn't understood gives null), all else a
    property. Blank nodes become objects inside, from the deepest level up; below five levels only a mark is left, which
    also ends cycles. A property that occurs again has its greatest value.
    """
    rows = materialize(triples.select("s", "p", "o", "o_kind", "o_datatype").where("s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL"))
    nodes = materialize(rows.where("o_kind = 'blank'").select(F.col("o").alias("node")).distinct())
    inner = nodes.select("node", F.lit(DEEPER).alias("json"))
    of_blank = rows.join(nodes, F.col("s") == F.col("node"), "left_semi")

    def with_values(table: DataFrame, inner: DataFrame) -> DataFrame:
        simple = table.where("o_kind <> 'blank'").select("s", "p", _json(F.col("o")).alias("json"))
        nested = table.where("o_kind = 'blank'").join(inner, F.col("o") == F.col("node")).select("s", "p", "json")
        return simple.union(nested)

    if not nodes.isEmpty():
        for _ in range(DEPTH + 1):
            made = _object(with_values(of_blank, inner), "s").select(F.col("s").alias("node"), F.col("json").alias("made"))
            # A blank node that nothing is said of is an empty object.
            inner = materialize(nodes.join(made, "node", "left").select("node", F.coalesce("made", F.lit("{}")).alias("json")))
    named = rows.where(~F.col("s").startswith("_:"))
    properties = _object(with_values(named.where(F.col("p") != GEOMETRY), inner), "s")
    shapes = named.where((F.col("p") == GEOMETRY) & (F.col("o_datatype") == WKT_LITERAL)).groupBy("s").agg(F.max("o").alias("wkt"))
    out = named.select("s").distinct().join(properties, "s", "left").join(shapes, "s", "left")
    value = F.concat(F.lit('{"type":"Feature","id":'), _json(F.col("s")), F.lit(',"geometry":'), F.coalesce(geof.geojson("wkt"), F.lit("null")), F.lit(',"properties":'), F.coalesce("json", F.lit("{}")), F.lit("}"))
    return out.select("s", value.alias("value"))


def write_collection(features: DataFrame, path: str, attribution: str | None = None) -> None:
    """One file of a GeoJSON FeatureCollection for each partition of features (value), in their order."""
    noted = "" if attribution is None else f'"attribution":{json.dumps(attribution)},'
    framed(features, f'{{"type":"FeatureCollection",{noted}"features":[', ",", "]}").write.text(path)
