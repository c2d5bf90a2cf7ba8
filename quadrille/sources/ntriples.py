"""N-Triples and N-Quads lines as triples; a graph is a set, so repeated lines count once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The forms of terms, and what stands for escaped characters.
LINE = r'^\s*(<[^>]*>|_:\S+)\s+(<[^>]*>)\s+(<[^>]*>|_:\S+|"(?:[^"\\]|\\.)*"(?:\^\^<[^>]*>|@[A-Za-z0-9-]+)?)\s*(<[^>]*>|_:\S+)?\s*\.\s*(?:#.*)?$'
ESCAPES = [('\\"', '"'), ("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ("\\\\", "\\")]


def _unescaped(text: Column) -> Column:
    """``\\uXXXX`` and ``\\UXXXXXXXX`` as the characters that they name: parts at the marks, of which each but the first begins with digits."""

    def character(code: Column) -> Column:
        """UTF-8 of a code point in hexadecimal."""
        n = F.conv(code, 16, 10).cast("int")
        tail = lambda shift: F.lit(0x80).bitwiseOR(F.call_function("shiftright", n, F.lit(shift)).bitwiseAND(0x3F))
        head = lambda mark, shift: F.lit(mark).bitwiseOR(F.call_function("shiftright", n, F.lit(shift)))
        parts = F.when(n < 0x80, F.array(n)).when(n < 0x800, F.array(head(0xC0, 6), tail(0))).when(n < 0x10000, F.array(head(0xE0, 12), tail(6), tail(0))).otherwise(F.array(head(0xF0, 18), tail(12), tail(6), tail(0)))
        return F.unhex(F.array_join(F.transform(parts, lambda b: F.lpad(F.hex(b), 2, "0")), "")).cast("string")

    def part(x: Column, i: Column) -> Column:
        digits = F.when(x.startswith("U"), 8).otherwise(4)
        return F.when(i == 0, x).otherwise(F.concat(character(F.substring(x, F.lit(2), digits)), F.substring(x, digits + 2, F.length(x))))

    marked = F.regexp_replace(text, r"\\(u[0-9A-Fa-f]{4}|U00(?:0[0-9A-Fa-f]|10)[0-9A-Fa-f]{4})", "\u0001$1")
    return F.when(F.contains(text, F.lit("\\")), F.array_join(F.transform(F.split(marked, "\u0001"), part), "")).otherwise(text)


def _plain(term: Column) -> Column:
    return F.when(term.startswith("<"), _unescaped(F.substring(term, F.lit(2), F.length(term) - 2))).otherwise(term)


def parse(lines: DataFrame, value: str = "value", graphs: bool = False) -> DataFrame:
    """(s, p, o, o_kind, o_datatype, o_lang) of lines, and with ``graphs`` their graph's name (g; null without one). Blank lines, comments and broken lines are left out."""
    part = lambda i: F.regexp_extract(value, LINE, i)
    terms = lines.where(F.col(value).rlike(LINE)).select(_plain(part(1)).alias("s"), _plain(part(2)).alias("p"), part(3).alias("t"), *([F.when(part(4) != "", _plain(part(4))).alias("g")] if graphs else []))
    literal = F.col("t").startswith('"')
    text = F.regexp_extract("t", r'^"((?:[^"\\]|\\.)*)"', 1)
    # A backslash is put aside first, so that what it escapes isn't read twice.
    text = F.replace(text, F.lit("\\\\"), F.lit("\u0000"))
    for old, new in ESCAPES[:-1]:
        text = F.replace(text, F.lit(old), F.lit(new))
    text = F.replace(_unescaped(text), F.lit("\u0000"), F.lit("\\"))
    kind = F.when(literal, "literal").when(F.col("t").startswith("_:"), "blank").otherwise("iri")
    none = lambda c: F.when(c != "", c)
    datatype, lang = none(F.regexp_extract("t", r'"\^\^<([^>]*)>$', 1)), none(F.regexp_extract("t", r'"@([A-Za-z0-9-]+)$', 1))
    return terms.select(*(["g"] if graphs else []), "s", "p", F.when(literal, text).otherwise(_plain(F.col("t"))).alias("o"), kind.alias("o_kind"), F.when(literal, datatype).alias("o_datatype"), F.when(literal, lang).alias("o_lang")).distinct()


def read(spark: SparkSession, path: str, graphs: bool = False) -> DataFrame:
    return parse(spark.read.text(path), graphs=graphs)
