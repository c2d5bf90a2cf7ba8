"""Solutions of patterns as result documents: JSON, XML and tab-separated, a row of text for each solution.

Variables are columns of terms (``functions.terms``); other columns stand for
plain literals. An unbound variable is left out, or is an empty field. Writers
put a document's begin and end around the rows of each partition, so a result
of one partition is one document.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.functions import terms
from quadrille.functions.text import LITERAL, XML, escaped

# The names of the two result formats.
NAMES = {"iri": "uri", "blank": "bnode", "literal": "literal"}
RESULTS_XML = "http://www.w3.org/2005/sparql-results#"


def _terms(df: DataFrame) -> dict[str, Column]:
    kinds = dict(df.dtypes)
    return {c: F.col(f"`{c}`") if kinds[c].startswith("struct<value:string,kind:string") else terms.literal(F.col(f"`{c}`").cast("string")) for c in df.columns}


def _label(t: Column) -> Column:
    return F.regexp_replace(t["value"], "^_:", "")


def _value(t: Column) -> Column:
    return F.when(t["kind"] == "blank", _label(t)).otherwise(t["value"])


def as_json(df: DataFrame) -> DataFrame:
    """(value): an object of bindings for each solution."""
    text = lambda c: F.regexp_extract(F.to_json(F.struct(c.alias("x"))), r'^\{"x":([\s\S]*)\}$', 1)

    def binding(name: str, t: Column) -> Column:
        kind = F.when(t["kind"] == "iri", NAMES["iri"]).when(t["kind"] == "blank", NAMES["blank"]).otherwise(NAMES["literal"])
        fields = F.concat_ws(",", F.concat(F.lit('"type":'), text(kind)), F.concat(F.lit('"value":'), text(_value(t))), F.when(t["lang"].isNotNull(), F.concat(F.lit('"xml:lang":'), text(t["lang"]))), F.when(t["datatype"].isNotNull(), F.concat(F.lit('"datatype":'), text(t["datatype"]))))
        return F.when(t.isNotNull(), F.concat(F.lit(json.dumps(name) + ":{"), fields, F.lit("}")))

    return df.select(F.concat(F.lit("{"), F.concat_ws(",", *[binding(n, t) for n, t in _terms(df).items()]), F.lit("}")).alias("value"))


def as_xml(df: DataFrame) -> DataFrame:
    """(value): a ``result`` element for each solution."""

    def binding(name: str, t: Column) -> Column:
        safe = escaped(_value(t), XML)
        mark = F.coalesce(F.concat(F.lit(' xml:lang="'), t["lang"], F.lit('"')), F.concat(F.lit(' datatype="'), escaped(t["datatype"], XML), F.lit('"')), F.lit(""))
        inner = F.when(t["kind"] == "iri", F.concat(F.lit("<uri>"), safe, F.lit("</uri>"))).when(t["kind"] == "blank", F.concat(F.lit("<bnode>"), safe, F.lit("</bnode>"))).otherwise(F.concat(F.lit("<literal"), mark, F.lit(">"), safe, F.lit("</literal>")))
        return F.when(t.isNotNull(), F.concat(F.lit(f'<binding name="{name}">'), inner, F.lit("</binding>")))

    return df.select(F.concat(F.lit("<result>"), F.concat_ws("", *[binding(n, t) for n, t in _terms(df).items()]), F.lit("</result>")).alias("value"))


def as_tsv(df: DataFrame) -> DataFrame:
    """(value): terms as in triples, between tabs; numbers stand as they are."""

    def field(t: Column) -> Column:
        mark = F.coalesce(F.concat(F.lit("@"), t["lang"]), F.concat(F.lit("^^<"), t["datatype"], F.lit(">")), F.lit(""))
        literal = F.when(terms.number(t).isNotNull() & t["datatype"].isin("xsd:integer", "xsd:decimal", "xsd:double"), t["value"]).otherwise(F.concat(F.lit('"'), escaped(t["value"], LITERAL), F.lit('"'), mark))
        out = F.when(t["kind"] == "iri", F.concat(F.lit("<"), t["value"], F.lit(">"))).when(t["kind"] == "blank", F.concat(F.lit("_:"), _label(t))).otherwise(literal)
        return F.coalesce(F.when(t.isNotNull(), out), F.lit(""))

    return df.select(F.concat_ws("\t", *[field(t) for t in _terms(df).values()]).alias("value"))


def framed(rows: DataFrame, begin: str, between: str, end: str | None) -> DataFrame:
    """(value): rows (value) of each partition as one document; ``between`` stands before all but the first. A partition without rows gives nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = True
        for batch in batches:
            values = batch.column(0).to_pylist()
            if values:
                lines = ([begin] if first else []) + [v if first and i == 0 else between + v for i, v in enumerate(values)]
                first = False
                yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], ["value"])
        if not first and end is not None:
            yield pa.RecordBatch.from_arrays([pa.array([end], pa.string())], ["value"])

    return rows.select("value").mapInArrow(run, "value string")


def write(df: DataFrame, path: str, form: str = "json") -> None:
    """Solutions as documents of one form (json, xml or tsv), in their order."""
    names = df.columns
    if form == "json":
        out = framed(as_json(df), f'{{"head":{{"vars":{json.dumps(names)}}},"results":{{"bindings":[', ",", "]}}")
    elif form == "xml":
        head = "".join(f'<variable name="{n}"/>' for n in names)
        out = framed(as_xml(df), f'<?xml version="1.0"?>\n<sparql xmlns="{RESULTS_XML}"><head>{head}</head><results>', "", "</results></sparql>")
    elif form == "tsv":
        head = "\t".join(f"?{n}" for n in names)
        out = framed(as_tsv(df), head, "", None)
    else:
        raise ValueError(f"no such form: {form}")
    out.write.text(path)


def ask_json(answer: bool) -> str:
    return json.dumps({"boolean": bool(answer)})
