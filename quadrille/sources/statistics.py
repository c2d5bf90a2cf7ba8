"""Answers of a tag-statistics service in JSON (column value), as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The answers' forms.
OVERVIEW = "data array<struct<type:string,count:long>>"
VALUES = "data array<struct<value:string,count:long,in_wiki:boolean,description:string>>"
KEYS = "data array<struct<key:string,count_all:long>>"
PAGES = "data array<struct<lang:string,title:string,description:string>>"
ITEMS = "search array<struct<id:string,label:string,description:string>>"


def _rows(answers: DataFrame, schema: str, field: str = "data") -> DataFrame:
    return answers.select(F.inline(F.from_json("value", schema)[field]))


def overview(answers: DataFrame) -> DataFrame:
    """(type, count): uses by type of element; unused types are left out."""
    return _rows(answers, OVERVIEW).where("count > 0")


def values(answers: DataFrame) -> DataFrame:
    """(value, count, in_wiki, description) of non-empty values."""
    return _rows(answers, VALUES).where("value <> ''")


def keys(answers: DataFrame) -> DataFrame:
    """(k, uses)."""
    return _rows(answers, KEYS).select(F.col("key").alias("k"), F.col("count_all").alias("uses")).where("k <> ''").distinct()


def english_page(answers: DataFrame) -> DataFrame:
    """(title, description) of English pages with a title."""
    return _rows(answers, PAGES).where("lang = 'en' AND title <> ''").select("title", "description")


def definition(items: DataFrame, label: str) -> DataFrame:
    """(id, description): the first item that has exactly this label; an empty description is null."""
    hits = F.filter(F.from_json("value", ITEMS)["search"], lambda x: x["label"] == label)
    hit = items.select(F.try_element_at(hits, F.lit(1)).alias("hit")).where("hit is not null")
    return hit.select("hit.id", F.nullif(F.col("hit.description"), F.lit("")).alias("description"))
