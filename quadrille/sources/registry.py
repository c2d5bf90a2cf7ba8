"""Registries of regions and of example questions (JSON documents), as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The forms of the two documents.
REGIONS = "regions map<string,struct<file:string,source:string,licence:string,integrated:boolean>>"
EXAMPLES = "examples array<struct<source:string,name:string,query:string>>"


def _documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True)


def regions(spark: SparkSession, path: str) -> DataFrame:
    """(region, file, source, licence, integrated) of all registries at ``path``; a document that isn't one has no rows."""
    return _documents(spark, path).select(F.explode(F.from_json("value", REGIONS)["regions"]).alias("region", "entry")).select("region", "entry.*")


def examples(spark: SparkSession, path: str) -> DataFrame:
    """(at, source, name, query), in order."""
    return _documents(spark, path).select(F.posexplode(F.from_json("value", EXAMPLES)["examples"]).alias("at", "entry")).select("at", "entry.*")
