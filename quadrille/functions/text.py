"""Tags, links and escapes as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_value(tags: Column, key: str) -> Column:
    """Value of the first tag with a key, of an array of (k, v) in document order."""
    return F.try_element_at(F.filter(tags, lambda t: t["k"] == key), F.lit(1))["v"]


def fixed7(value7: Column) -> Column:
    """A coordinate in 1e-7 degrees as text with all seven decimals."""
    return (value7.cast("decimal(18,0)") / F.lit(10000000).cast("decimal(8,0)")).cast("decimal(18,7)").cast("string")


def percent_encoded(text: Column) -> Column:
    """RFC 3986: everything but unreserved characters as %XX."""
    return F.replace(F.replace(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def wikidata_url(value: Column) -> Column:
    return F.when(value.rlike("^[QP][0-9]+$"), F.concat(F.lit("https://www.wikidata.org/wiki/"), value))


def wikipedia_url(value: Column) -> Column:
    """``lang:Title`` as the article's address; null without a language."""
    at = F.instr(value, ":")
    title = F.replace(F.substring(value, at + 1, F.length(value)), F.lit(" "), F.lit("_"))
    return F.when(at > 1, F.concat(F.lit("https://"), F.substring(value, F.lit(1), at - 1), F.lit(".wikipedia.org/wiki/"), title))


def wikidata_entity(value: Column) -> Column:
    """The entity's address in triples, of any value."""
    return F.concat(F.lit("http://www.wikidata.org/entity/"), value)


def wikipedia_triples(value: Column) -> Column:
    """(page, same_as) in triples. The language are the first two characters; without a colon the value is an article of the English resource."""
    colon = F.contains(value, F.lit(":"))
    lang, rest = F.substring(value, 1, 2), percent_encoded(F.substring(value, F.lit(4), F.greatest(F.length(value) - 3, F.lit(0))))
    english = F.lit("http://dbpedia.org/resource/")
    page = F.when(colon, F.concat(F.lit("http://"), lang, F.lit(".wikipedia.org/wiki/"), rest))
    same = F.when(~colon, F.concat(english, percent_encoded(value))).when(lang == "en", F.concat(english, rest)).otherwise(F.concat(F.lit("http://"), lang, F.lit(".dbpedia.org/resource/"), rest))
    return F.when(value.isNotNull(), F.struct(page.alias("page"), same.alias("same_as")))


def property_value(k: Column, v: Column) -> Column:
    """A tag's value among a feature's properties: links for articles and data items, where the value has their form."""
    item = F.when((k == "wikidata") & v.rlike("^[QP][0-9]+$"), wikidata_url(v))
    at = F.instr(v, ":")
    title = F.replace(F.substring(v, at + 1, F.length(v)), F.lit(" "), F.lit("_"))
    article = F.when((k == "wikipedia") & (at > 0), F.concat(F.lit("https://"), F.substring(v, F.lit(1), at - 1), F.lit(".wikipedia.org/wiki/"), title))
    return F.coalesce(item, article, v)


def wiki_page_url(title: Column) -> Column:
    """A page of the documentation wiki, safe within XML."""
    return F.concat(F.lit("https://wiki.openstreetmap.org/wiki/"), escaped(F.replace(title, F.lit(" "), F.lit("_")), XML))


def definition(page: Column, item: Column) -> Column:
    """A page's description, else the data item's; null where both are empty."""
    return F.coalesce(F.nullif(page, F.lit("")), F.nullif(item, F.lit("")))


def redacted(text: Column, secret: str | None) -> Column:
    """The text without a secret that is part of it."""
    return F.replace(text, F.lit(secret), F.lit("redacted")) if secret else text


def element_id(text: Column) -> Column:
    """A positive whole number; null for anything else."""
    n = F.when(text.rlike("^[+]?[0-9]+$"), text.try_cast("bigint"))
    return F.when(n > 0, n)


def escaped(text: Column, pairs: list[tuple[str, str]]) -> Column:
    """Replacements in order."""
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


# Characters that must be escaped, and how.
XML = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")]
XML_DECODED = [("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'")]
LITERAL = [("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")]
