"""Terms of triples as structs (value, kind, datatype, lang), their order, and the functions of queries on them.

``kind`` is iri, blank or literal; a null struct is an unbound variable. An error is null, as everywhere in Spark's
own logic of three values; a filter drops both. Datatypes are written with the prefix ``xsd:``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TERM = "struct<value:string,kind:string,datatype:string,lang:string>"
# Datatypes that are numbers, those that are whole ones, and others that functions give.
WHOLE = ("xsd:integer", "xsd:int", "xsd:long", "xsd:short", "xsd:byte", "xsd:nonNegativeInteger", "xsd:positiveInteger", "xsd:nonPositiveInteger", "xsd:negativeInteger", "xsd:unsignedLong", "xsd:unsignedInt", "xsd:unsignedShort", "xsd:unsignedByte")
NUMERIC = (*WHOLE, "xsd:decimal", "xsd:float", "xsd:double")
STRING, BOOLEAN, DATE_TIME, LANG_STRING = "xsd:string", "xsd:boolean", "xsd:dateTime", "rdf:langString"


def _null() -> Column:
    return F.lit(None).cast("string")


def _text(x: Column | str) -> Column:
    return F.lit(x) if isinstance(x, str) else x


def iri(value: Column | str) -> Column:
    return F.struct(_text(value).alias("value"), F.lit("iri").alias("kind"), _null().alias("datatype"), _null().alias("lang"))


def blank(label: Column | str) -> Column:
    return F.struct(_text(label).alias("value"), F.lit("blank").alias("kind"), _null().alias("datatype"), _null().alias("lang"))


def literal(value: Column | str, datatype: Column | str | None = None, lang: Column | str | None = None) -> Column:
    """STRDT, STRLANG, or a plain literal; null where the value is."""
    out = F.struct(_text(value).alias("value"), F.lit("literal").alias("kind"), (_null() if datatype is None else _text(datatype)).alias("datatype"), (_null() if lang is None else F.lower(_text(lang))).alias("lang"))
    return F.when(_text(value).isNotNull(), out)


def term(df_prefix: str = "o") -> Column:
    """The object of a table of triples; columns that it lacks (``o_lang``) are to be added as null first."""
    return F.when(F.col(df_prefix).isNotNull(), F.struct(F.col(df_prefix).alias("value"), F.col(f"{df_prefix}_kind").alias("kind"), F.col(f"{df_prefix}_datatype").alias("datatype"), F.col(f"{df_prefix}_lang").alias("lang")))


# Tests and parts --------------------------------------------------------------


def is_iri(t: Column) -> Column:
    return t["kind"] == "iri"


def is_blank(t: Column) -> Column:
    return t["kind"] == "blank"


def is_literal(t: Column) -> Column:
    return t["kind"] == "literal"


def is_numeric(t: Column) -> Column:
    """A literal of a datatype for numbers whose text is one."""
    return F.when(t.isNotNull(), F.coalesce(number(t).isNotNull(), F.lit(False)))


def bound(t: Column) -> Column:
    return t.isNotNull()


def same_term(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), (a["value"] == b["value"]) & (a["kind"] == b["kind"]) & F.coalesce(a["datatype"], F.lit(STRING)).eqNullSafe(F.coalesce(b["datatype"], F.lit(STRING))) & F.coalesce(a["lang"], F.lit("")).eqNullSafe(F.coalesce(b["lang"], F.lit(""))))


def str_of(t: Column) -> Column:
    """STR: the text of a literal or an address; an error for blank nodes."""
    return F.when(t["kind"] != "blank", t["value"])


def lang(t: Column) -> Column:
    return F.when(is_literal(t), F.coalesce(t["lang"], F.lit("")))


def datatype(t: Column) -> Column:
    """The datatype of a literal, that of plain ones too."""
    return F.when(is_literal(t), F.coalesce(t["datatype"], F.when(t["lang"].isNotNull(), LANG_STRING).otherwise(STRING)))


def lang_matches(tag: Column, wanted: str) -> Column:
    """Whether a language tag is in a range: ``*``, or the tag itself or the first part of it."""
    if wanted == "*":
        return tag != ""
    low = F.lower(tag)
    return (low == wanted.lower()) | low.startswith(f"{wanted.lower()}-")


# Numbers ----------------------------------------------------------------------


def number(t: Column) -> Column:
    """The value of a numeric literal as a double; null for anything else."""
    text = t["value"]
    plain = F.when(text == "INF", F.lit(float("inf"))).when(text == "-INF", F.lit(float("-inf"))).when(text.rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"), text.try_cast("double"))
    return F.when(is_literal(t) & t["datatype"].isin(*NUMERIC), plain)


def rounded(x: Column) -> Column:
    """Halves go up, also below zero."""
    return F.floor(x + 0.5).cast("double")


def arithmetic(a: Column, sign: str, b: Column) -> Column:
    """``+ - * /`` of doubles; division by zero is an error."""
    return {"+": a + b, "-": a - b, "*": a * b, "/": F.try_divide(a, b)}[sign]


# Times ------------------------------------------------------------------------

_DATE_TIME = r"^(-?[0-9]{4,})-([0-9]{2})-([0-9]{2})T([0-9]{2}):([0-9]{2}):([0-9]{2}(?:\.[0-9]+)?)(Z|[+-][0-9]{2}:[0-9]{2})?$"


def _part(t: Column, i: int) -> Column:
    return F.when(is_literal(t) & (t["datatype"] == DATE_TIME) & t["value"].rlike(_DATE_TIME), F.regexp_extract(t["value"], _DATE_TIME, i))


def year(t: Column) -> Column:
    return _part(t, 1).try_cast("int")


def month(t: Column) -> Column:
    return _part(t, 2).try_cast("int")


def day(t: Column) -> Column:
    return _part(t, 3).try_cast("int")


def hours(t: Column) -> Column:
    return _part(t, 4).try_cast("int")


def minutes(t: Column) -> Column:
    return _part(t, 5).try_cast("int")


def seconds(t: Column) -> Column:
    return _part(t, 6).try_cast("decimal(18,6)")


def tz(t: Column) -> Column:
    """The zone as it is written; empty without one."""
    return _part(t, 7)


def timezone(t: Column) -> Column:
    """The zone as a duration; an error without one."""
    zone = _part(t, 7)
    h, m = F.substring(zone, 2, 2).try_cast("int"), F.substring(zone, 5, 2).try_cast("int")
    amount = F.concat(F.when(h > 0, F.concat(h.cast("string"), F.lit("H"))).otherwise(""), F.when(m > 0, F.concat(m.cast("string"), F.lit("M"))).otherwise(""))
    sign = F.when(zone.startswith("-"), "-").otherwise("")
    return F.when((zone == "Z") | ((h == 0) & (m == 0)), "PT0S").when(zone != "", F.concat(sign, F.lit("PT"), amount))


def instant(t: Column) -> Column:
    """A dateTime as a timestamp; one without a zone is taken as UTC."""
    return F.when(_part(t, 1).isNotNull(), F.try_to_timestamp(F.when(_part(t, 7) == "", F.concat(t["value"], F.lit("Z"))).otherwise(t["value"])))


# Texts ------------------------------------------------------------------------


def before(text: Column, part: str) -> Column:
    """STRBEFORE: empty where the part isn't in the text."""
    at = F.instr(text, part)
    return F.when(F.lit(part == ""), F.lit("")).when(at > 0, F.substring(text, F.lit(1), at - 1)).otherwise("")


def after(text: Column, part: str) -> Column:
    at = F.instr(text, part)
    return F.when(F.lit(part == ""), text).when(at > 0, F.substring(text, at + len(part), F.length(text))).otherwise("")


def hashed(text: Column, name: str) -> Column:
    """MD5, SHA1, SHA256, SHA384 or SHA512 of a text in UTF-8, in hexadecimal."""
    return F.md5(text) if name == "MD5" else F.sha1(text) if name == "SHA1" else F.sha2(text, int(name[3:]))


def regex(text: Column, pattern: str, flags: str = "") -> Column:
    return text.rlike(f"(?{flags}){pattern}" if flags else pattern)


# Casts ------------------------------------------------------------------------


def cast(t: Column, to: str) -> Column:
    """A term as a literal of one of xsd's boolean, integer, decimal, float, double, string and dateTime; an error is null."""
    text, n = F.trim(t["value"]), number(t)
    source = F.when(is_literal(t), text)
    truth = F.when(t["datatype"] == BOOLEAN, F.when(text.isin("true", "1"), True).when(text.isin("false", "0"), False))
    of_truth = F.when(truth, 1.0).when(~truth, 0.0)
    plain = F.when(F.coalesce(t["datatype"], F.lit(STRING)) == STRING, source)
    decimal = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)$"
    if to == STRING:
        return literal(F.when(t["kind"] != "blank", t["value"]), STRING)
    if to == BOOLEAN:
        value = F.coalesce(truth, n.isNotNull() & (n != 0) & ~F.isnan(n)) if to == BOOLEAN else None
        value = F.when(truth.isNotNull(), truth).when(n.isNotNull(), (n != 0) & ~F.isnan(n)).when(plain.isin("true", "1"), True).when(plain.isin("false", "0"), False)
        return literal(value.cast("string"), to)
    if to == DATE_TIME:
        fine = F.when(F.coalesce(t["datatype"], F.lit(STRING)).isin(STRING, DATE_TIME) & text.rlike(_DATE_TIME), text)
        return literal(F.when(is_literal(t), fine), to)
    value = F.coalesce(n, of_truth)
    if to in ("xsd:float", "xsd:double"):
        fine = F.coalesce(value, number(literal(plain, "xsd:double")))
        return literal(fine.cast("float" if to == "xsd:float" else "double").cast("string"), to)
    if to == "xsd:integer":
        fine = F.coalesce(F.when(value < 0, F.ceil(value)).otherwise(F.floor(value)).cast("string"), F.when(plain.rlike(r"^[+-]?[0-9]+$"), plain.try_cast("decimal(38,0)").cast("string")))
        return literal(F.when(F.coalesce(F.abs(value) < 9.2e18, F.lit(True)), fine), to)
    if to == "xsd:decimal":
        exact = F.when((t["datatype"].isin(*WHOLE, to) | (F.coalesce(t["datatype"], F.lit(STRING)) == STRING)) & source.rlike(decimal), source.try_cast("decimal(38,12)"))
        found = F.coalesce(exact, value.try_cast("decimal(38,12)"))
        return literal(F.regexp_replace(F.regexp_replace(found.cast("string"), r"(\.[0-9]*?)0+$", "$1"), r"\.$", ""), to)
    raise ValueError(f"no such datatype: {to}")


# Order ------------------------------------------------------------------------


def order(t: Column, descending: bool = False) -> list[Column]:
    """Sort keys of a term: unbound, then blank nodes, addresses and literals; numbers by value, times by instant, the rest by text, datatype and language.

    Among literals, numbers come first, then truth values, times, plain texts and all others, so that the order is total and the same each time.
    """
    rank = F.when(t.isNull(), 0).when(is_blank(t), 1).when(is_iri(t), 2).otherwise(3)
    group = F.when(~is_literal(t) | t.isNull(), 0).when(number(t).isNotNull(), 1).when(t["datatype"] == BOOLEAN, 2).when(instant(t).isNotNull(), 3).when(F.coalesce(t["datatype"], F.lit(STRING)) == STRING, 4).otherwise(5)
    keys = [rank, group, number(t), instant(t), t["value"], F.coalesce(t["datatype"], F.lit("")), F.coalesce(t["lang"], F.lit(""))]
    return [F.desc_nulls_last(k) if descending else F.asc_nulls_first(k) for k in keys]
