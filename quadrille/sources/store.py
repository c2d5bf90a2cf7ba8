"""A store of elements in the order of (type, id), with an index of its blocks.

Elements are dealt by ranges and sorted within them, so that the files together
are in order; a block is a run of a fixed number of rows. The index has a row
for each block and type with the first and last id, and the file that holds the
block. An id is looked up by a search in the index, and then only the files and
row groups that may hold it are read.

A folder of a store holds ``elements`` and ``index`` (Parquet) and ``manifest``
(JSON lines of key and value, in order). Elements have any columns beside
``type`` and ``id``. Rows without an id, or of an unknown type, are refused, as
are two elements of one type and id.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadrille.functions.search import count_below
from quadrille.operators.select import TYPES
from quadrille.tables import materialize

FORMAT = "quadrille-store-1"
#: Rows of a block.
BLOCK_ROWS = 8000
_ROW_BITS = 33


def type_rank(kind: Column | str = "type") -> Column:
    """0, 1, 2 for node, way and relation; null for anything else."""
    kind = F.col(kind) if isinstance(kind, str) else kind
    return F.when(kind == TYPES[0], 0).when(kind == TYPES[1], 1).when(kind == TYPES[2], 2)


def ordered(elements: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``elements`` in the order of (type, id), with ``part`` (of the ranges) and ``block``; written to the shared folder.

    A row's place is the one in its range, behind the counts of the ranges before; these are a row for each partition.
    """
    n = int(elements.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranked = elements.withColumn("_rank", type_rank()).repartitionByRange(n, "_rank", "id").sortWithinPartitions("_rank", "id")
    table = materialize(ranked.withColumn("_at", F.monotonically_increasing_id()))
    table = table.withColumn("part", F.call_function("shiftright", "_at", F.lit(_ROW_BITS)).cast("int")).withColumn("_row", F.col("_at").bitwiseAND((1 << _ROW_BITS) - 1))
    counts = table.groupBy("part").agg(F.count("*").alias("n"))  # a row for each partition
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("_before"))
    placed = table.join(F.broadcast(before), "part")
    return placed.withColumn("block", F.floor((F.col("_before") + F.col("_row")) / block_rows)).drop("_rank", "_at", "_row", "_before")


def block_ranges(blocks: DataFrame) -> DataFrame:
    """(block, type, first_id, last_id, n) of rows (block, type, id)."""
    return blocks.groupBy("block", "type").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.count("*").alias("n"))


def violations(elements: DataFrame) -> DataFrame:
    """(kind, n) of what a store can't hold: rows without a known type or id, and elements that another row repeats."""
    unknown = elements.where(type_rank().isNull() | F.col("id").isNull()).agg(F.lit("unknown").alias("kind"), F.count("*").alias("n"))
    repeated = elements.groupBy("type", "id").agg(F.count("*").alias("n")).where("n > 1").agg(F.lit("repeated").alias("kind"), F.count("*").alias("n"))
    return unknown.union(repeated)


@dataclass(frozen=True)
class Store:
    """An opened store: its elements, index and manifest."""

    spark: SparkSession
    path: str

    @property
    def elements(self) -> DataFrame:
        """All elements with ``block``."""
        return self.spark.read.parquet(f"{self.path}/elements")

    @property
    def index(self) -> DataFrame:
        """(block, type, first_id, last_id, n, file)."""
        return self.spark.read.parquet(f"{self.path}/index")

    def manifest(self) -> dict[str, str]:
        rows = self.spark.read.json(f"{self.path}/manifest", schema="at int, key string, value string").orderBy("at").collect()
        return {r.key: r.value for r in rows}

    def lookup(self, wanted: DataFrame) -> DataFrame:
        """``wanted`` (type, id) with ``block``: the one whose range holds the id, null without one."""
        return lookup(self.index, wanted)

    def fetch(self, wanted: DataFrame) -> DataFrame:
        """The elements of ``wanted`` (type, id). Only files that may hold one are read, and of these the blocks."""
        placed = materialize(self.lookup(wanted.select("type", "id").distinct()).where("block IS NOT NULL"))
        hit = placed.select("block").distinct()
        files = self.index.join(hit, "block", "left_semi").agg(F.collect_set("file").alias("f"), F.min("block").alias("a"), F.max("block").alias("z")).first()
        if not files.f:  # at most as many names as the store has files
            return self.elements.limit(0)
        found = self.spark.read.schema(self.elements.schema).parquet(*[f"{self.path}/elements/{f}" for f in sorted(files.f)])
        return found.where(F.col("block").between(files.a, files.z)).join(placed, ["type", "id", "block"], "left_semi").select(*found.columns)


def lookup(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` with ``block``: of its type's blocks the first whose last id isn't below, if its first id isn't above.

    The search runs over the last ids of blocks, which the driver holds: some bytes for each block of some megabytes.
    """
    rows = sorted((TYPES.index(r.type), r.first_id, r.last_id, r.block) for r in index.select("type", "first_id", "last_id", "block").collect())
    out = F.lit(None).cast("long")
    for rank, kind in enumerate(TYPES):
        own = [r for r in rows if r[0] == rank]
        if own:
            at = count_below(F.col("id"), [r[2] for r in own])
            entry = lambda values: F.get(F.from_json(F.lit(json.dumps(values)), "array<bigint>"), at)  # noqa: E731,B023
            out = F.when((F.col("type") == kind) & (entry([r[1] for r in own]) <= F.col("id")), entry([r[3] for r in own])).otherwise(out)
    return wanted.withColumn("block", out)


def write(elements: DataFrame, path: str, region: str = "", source: str = "", built: str = "", header: dict | None = None, incomplete: dict[str, DataFrame] | None = None, block_rows: int = BLOCK_ROWS) -> Store:
    """Write a store of ``elements`` (type, id, ...) and open it.

    ``header``: the replication state that a block file names; ``incomplete``: by type, ids (column id) of elements
    that refer to missing ones, which are counted in the manifest and written beside the index.
    """
    spark = elements.sparkSession
    if bad := [(r.kind, r.n) for r in violations(elements).collect() if r.n]:
        raise ValueError(f"not a store's elements: {bad}")
    placed = ordered(elements, block_rows)
    # Each range becomes a task's file or, with maxRecordsPerFile, several; they keep the order.
    placed.repartition(F.col("part")).sortWithinPartitions("part", type_rank(), "id").drop("part").write.parquet(f"{path}/elements")
    written = spark.read.parquet(f"{path}/elements").select("block", "type", "id", F.col("_metadata.file_name").alias("file"))
    index = written.groupBy("block", "type", "file").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.count("*").alias("n"))
    index.select("block", "type", "first_id", "last_id", "n", "file").repartition(1).sortWithinPartitions("block", type_rank(), "first_id").write.parquet(f"{path}/index")
    counts = {r.type: r.n for r in spark.read.parquet(f"{path}/index").groupBy("type").agg(F.sum("n").alias("n")).collect()}
    blocks = spark.read.parquet(f"{path}/index").select("block").distinct().count()
    header = header or {}
    state = {"format": FORMAT, "region": region, "built": built, "source": source, "replication_timestamp": header.get("replication_timestamp") or "", "replication_sequence": -1 if header.get("replication_sequence") is None else header["replication_sequence"], "blocks": blocks}
    state |= {f"{t}s": counts.get(t, 0) for t in TYPES}
    for t, ids in (incomplete or {}).items():
        ids.select("id").distinct().write.parquet(f"{path}/incomplete_{t}s")
        state[f"incomplete_{t}s"] = spark.read.parquet(f"{path}/incomplete_{t}s").count()
    rows = [(i, k, str(v)) for i, (k, v) in enumerate(state.items())]
    spark.createDataFrame(rows, "at int, key string, value string").coalesce(1).write.json(f"{path}/manifest")
    return Store(spark, path)


def parse_manifest(text: str) -> dict[str, str]:
    """``key=value`` lines; blank lines and comments are left out."""
    out = {}
    for line in text.splitlines():
        if line.strip() and not line.startswith("#"):
            key, sign, value = line.partition("=")
            if not sign or not key:
                raise ValueError(f"not key=value: {line}")
            out[key.strip()] = value.strip()
    return out


def order_breaks(blocks: DataFrame) -> DataFrame:
    """(block, type) of index rows that begin before the one before them ends, in the order of type and block."""
    at = Window.partitionBy("type").orderBy("block", "first_id")
    return blocks.withColumn("_last", F.lag("last_id").over(at)).where("first_id <= _last").select("block", "type")
