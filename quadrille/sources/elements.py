"""Element tables: nodes, ways, relations, their tags and ordered references.

``Elements.from_tables`` projects star-schema tables onto the element model, so
that every operator can be run and checked on them; ``PROJECTION`` holds that
projection as SQL which Spark and DuckDB both run.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

# Text by table; braces name the source tables. Order matters: later ones use earlier ones.
PROJECTION = {
    "nodes": """
        SELECT p_partkey + 1 AS id, 494000000 + CAST(floor(p_partkey / 50) AS bigint) * 20000 AS lat7, 110000000 + (p_partkey % 50) * 20000 AS lon7,
               (494000000 + CAST(floor(p_partkey / 50) AS bigint) * 20000) / 1e7 AS lat, (110000000 + (p_partkey % 50) * 20000) / 1e7 AS lon
        FROM {part}""",
    "node_tags": """
        SELECT p_partkey + 1 AS id, 0 AS seq, 'amenity' AS k, p_type AS v FROM {part}
        UNION ALL SELECT p_partkey + 1, 1, 'brand', p_brand FROM {part}
        UNION ALL SELECT p_partkey + 1, 2, 'size', CAST(p_size AS varchar(20)) FROM {part}
        UNION ALL SELECT p_partkey + 1, 3, 'name', p_name FROM {part}
        UNION ALL SELECT p_partkey + 1, 4, 'name:en', p_name FROM {part} WHERE p_partkey % 3 = 0
        UNION ALL SELECT p_partkey + 1, 5, 'name:de', p_name FROM {part} WHERE p_partkey % 5 = 0""",
    "ways": "SELECT o_orderkey + 1 AS id, o_orderdate AS ts FROM {orders}",
    "way_tags": """
        SELECT o_orderkey + 1 AS id, 0 AS seq, CASE WHEN o_orderstatus = 'F' THEN 'building' ELSE 'highway' END AS k,
               CASE WHEN o_orderstatus = 'F' THEN 'yes' ELSE o_orderpriority END AS v
        FROM {orders}""",
    "open_way_nodes": """
        SELECT l_orderkey + 1 AS way_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS bigint) AS seq, l_partkey + 1 AS node_id
        FROM {lineitem}""",
    "way_ends": """
        SELECT way_id, count(*) AS n, max(CASE WHEN seq = 0 THEN node_id END) AS first_node, max_by(node_id, seq) AS last_node
        FROM {open_way_nodes} GROUP BY way_id""",
    "way_nodes": """
        SELECT way_id, seq, node_id FROM {open_way_nodes}
        UNION ALL
        SELECT way_id, n, first_node FROM {way_ends} JOIN {orders} ON o_orderkey + 1 = way_id
        WHERE o_orderstatus = 'F' AND n >= 3 AND first_node <> last_node""",
    "relations": """
        SELECT c_custkey + 1 AS id FROM {customer}
        UNION ALL SELECT CAST(100000000 + n_nationkey AS bigint) FROM {nation}
        UNION ALL SELECT CAST(200000000 + r_regionkey AS bigint) FROM {region}""",
    "relation_tags": """
        SELECT c_custkey + 1 AS id, 0 AS seq, 'type' AS k, CASE c_mktsegment WHEN 'BUILDING' THEN 'multipolygon' WHEN 'HOUSEHOLD' THEN 'boundary' ELSE 'route' END AS v FROM {customer}
        UNION ALL SELECT c_custkey + 1, 1, 'name', c_name FROM {customer}
        UNION ALL SELECT CAST(100000000 + n_nationkey AS bigint), 0, 'name', n_name FROM {nation}
        UNION ALL SELECT CAST(200000000 + r_regionkey AS bigint), 0, 'name', r_name FROM {region}""",
    "relation_members": """
        SELECT o_custkey + 1 AS rel_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS bigint) AS seq, 'way' AS type, o_orderkey + 1 AS ref,
               CASE WHEN substr(o_orderpriority, 1, 1) = '1' THEN 'inner' ELSE 'outer' END AS role
        FROM {orders}
        UNION ALL
        SELECT CAST(100000000 + c_nationkey AS bigint), CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS bigint), 'relation', c_custkey + 1, '' FROM {customer}
        UNION ALL
        SELECT CAST(200000000 + n_regionkey AS bigint), CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS bigint), 'relation', CAST(100000000 + n_nationkey AS bigint), '' FROM {nation}""",
    "changesets": "SELECT event_id + 1 AS id, ts AS created_at, user_id AS user_id, event_type AS comment FROM {events}",
}

#: What a task takes from shuffles, where the session doesn't say: Spark's usual 64 MB of packed ids are some 2 GB where they are joined and counted.
TASK_BYTES = "16m"

SOURCES = ("part", "orders", "lineitem", "customer", "nation", "region", "events")


#: Input bytes for each task of a shuffle: ids pack so well that 16 MB of them can be over a million rows.
TASK_INPUT = 3 << 20


def bound_tasks(spark: SparkSession, input_bytes: int = 0) -> None:
    """More data make more tasks, not larger ones.

    Spark joins small partitions up to the size of a task, but never cuts large ones, so the least number of both follows
    the input. What the session says itself stays.
    """
    size, adaptive = "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions"
    if spark.conf.get(size, None) is None:
        spark.conf.set(size, TASK_BYTES)
    tasks = -(-input_bytes // TASK_INPUT)
    for name, least in (("initialPartitionNum", int(spark.conf.get("spark.sql.shuffle.partitions"))), ("minPartitionNum", spark.sparkContext.defaultParallelism)):
        key, own = f"{adaptive}.{name}", f"quadrille.{name}"
        if spark.conf.get(key, None) == spark.conf.get(own, None):  # not set, or set here for other tables
            spark.conf.set(key, str(max(least, tasks)))
            spark.conf.set(own, spark.conf.get(key))


@dataclass(frozen=True)
class Elements:
    """The element model as lazy DataFrames."""

    nodes: DataFrame
    node_tags: DataFrame
    ways: DataFrame
    way_tags: DataFrame
    way_nodes: DataFrame
    relations: DataFrame
    relation_tags: DataFrame
    relation_members: DataFrame
    changesets: DataFrame

    @classmethod
    def from_tables(cls, spark: SparkSession, sf_dir: str) -> Elements:
        """Project the star-schema tables below ``sf_dir``; each is read only where a query needs it."""
        known = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in SOURCES}
        bound_tasks(spark, sum(int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) for df in known.values()))
        for name, text in PROJECTION.items():
            known[name] = spark.sql(text, **{t: df for t, df in known.items() if f"{{{t}}}" in text})
        return cls(**{f: known[f] for f in cls.__dataclass_fields__})


def projection_ctes(*names: str) -> str:
    """``WITH`` clause of DuckDB SQL that defines these element tables over the registered views."""
    wanted = set(names)
    for name in reversed(list(PROJECTION)):
        if name in wanted:
            wanted |= {t for t in PROJECTION if f"{{{t}}}" in PROJECTION[name]}
    ctes = [f"{n} AS ({t.format(**{s: s for s in (*SOURCES, *PROJECTION)})})" for n, t in PROJECTION.items() if n in wanted]
    return "WITH " + ",\n".join(ctes)
