"""Tag statistics and concepts. All start from (type, id, seq, k, v)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Uses from which a namespace variant counts, values listed of a key, and length of the key index.
LEAST_USES, TOP_VALUES, INDEX_KEYS = 1000, 20, 200


def usage(tags: DataFrame, *keys: str) -> DataFrame:
    """Uses by ``keys`` (k, or k and v): all, and by type of element."""
    by_type = [F.count_if(F.col("type") == t).alias(f"{t}s") for t in ("node", "way", "relation")]
    return tags.groupBy(*keys).agg(F.count("*").alias("uses"), *by_type)


def top_values(tags: DataFrame, n: int = TOP_VALUES) -> DataFrame:
    """(k, v, uses, rank): a key's commonest non-empty values."""
    counts = tags.where("v <> ''").groupBy("k", "v").agg(F.count("*").alias("uses"))
    rank = F.row_number().over(Window.partitionBy("k").orderBy(F.desc("uses"), "v"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= n)


def indexable(key: Column) -> Column:
    """Keys of the index: without a colon, not led by a capital or a special character."""
    return key.rlike("^[^*:+A-Z][^:]*$")


def key_index(tags: DataFrame, n: int = INDEX_KEYS) -> DataFrame:
    """(k, uses): the commonest keys, those of them that belong in the index."""
    counts = tags.groupBy("k").agg(F.count("*").alias("uses"))
    return counts.orderBy(F.desc("uses"), "k").limit(n).where(indexable(F.col("k")))


def namespace_variants(tags: DataFrame, base: str, least: int = LEAST_USES) -> DataFrame:
    """(k, uses) of keys ``base:...`` with at least ``least`` uses."""
    return tags.where(F.col("k").startswith(f"{base}:")).groupBy("k").agg(F.count("*").alias("uses")).where(F.col("uses") >= least)


def confirmed_values(tags: DataFrame, documented: DataFrame, key: str) -> DataFrame:
    """(v, uses, confirmed): a key's values; confirmed ones are in ``documented`` (column v)."""
    counts = tags.where(F.col("k") == key).groupBy("v").agg(F.count("*").alias("uses"))
    return counts.join(documented.select("v", F.lit(True).alias("found")).distinct(), "v", "left").select("v", "uses", F.coalesce("found", F.lit(False)).alias("confirmed"))


def concepts(tags: DataFrame, documented: DataFrame, key: str) -> DataFrame:
    """(s, p, o) of a key's concept scheme: each value is a concept, confirmed ones are narrower concepts of the key."""
    top = f"/tag/{key}#concept"
    value = F.concat(F.lit(f"/tag/{key}="), F.col("v"), F.lit("#concept"))
    rows = confirmed_values(tags, documented, key)
    triple = lambda s, p, o: F.struct(s.alias("s"), F.lit(p).alias("p"), o.alias("o"))
    each = F.array(
        triple(value, "rdf:type", F.lit("skos:Concept")),
        triple(value, "skos:notation", F.col("v")),
        F.when(F.col("confirmed"), triple(F.lit(top), "skos:narrower", value)).otherwise(triple(F.lit(top), "skos:example", F.col("v"))),
    )
    return rows.select(F.explode(each).alias("t")).select("t.*").distinct()
