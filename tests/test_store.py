import pytest
from pyspark.sql import functions as F

from quadrille.functions.search import count_below
from quadrille.sources import store


@pytest.fixture(scope="module")
def elements(spark):
    rows = [("node", i * i) for i in range(1, 400)] + [("way", i * 7 - 3000) for i in range(1000)] + [("relation", 5), ("relation", 10**12)]
    return spark.createDataFrame([(t, i, f"{t} {i}") for t, i in rows], "type string, id long, name string").repartition(5)


def in_order(elements):
    return sorted(((store.TYPES.index(r.type), r.id) for r in elements.collect()))


def test_blocks_are_runs_in_order(elements):
    rows = in_order(elements)
    got = {(store.TYPES.index(r.type), r.id): r.block for r in store.ordered(elements, 64).collect()}
    assert got == {x: i // 64 for i, x in enumerate(rows)}
    index = store.block_ranges(store.ordered(elements, 64)).collect()
    for r in index:
        own = [i for k, i in rows if got[k, i] == r.block and store.TYPES[k] == r.type]
        assert (r.first_id, r.last_id, r.n) == (own[0], own[-1], len(own))
    assert store.order_breaks(store.block_ranges(store.ordered(elements, 64))).count() == 0
    broken = store.block_ranges(store.ordered(elements, 64)).withColumn("first_id", F.when(F.col("block") == 9, -(10**9)).otherwise(F.col("first_id")))
    assert store.order_breaks(broken).count() == 1


def test_lookup_in_uneven_blocks(spark, elements):
    index = store.block_ranges(store.ordered(elements, 64))
    entries = [tuple(r) for r in index.select("type", "first_id", "last_id", "block").collect()]
    wanted = [(t, i) for t in (*store.TYPES, "area") for i in (-10**15, -3000, -2999, 0, 1, 2, 3, 5, 6, 1000, 4096, 159201, 10**12, 10**12 + 1)] + [("node", None), (None, 1)]
    got = {(r.type, r.id): r.block for r in store.lookup(index, spark.createDataFrame(wanted, "type string, id long")).collect()}
    assert got == {(t, i): next((b for k, first, last, b in entries if k == t and i is not None and first <= i <= last), None) for t, i in wanted}


def test_written_and_fetched(spark, elements, tmp_path):
    bad = spark.createDataFrame([(3,), (4,), (4,)], "id long")
    state = {"replication_timestamp": "2024-01-01T00:00:00Z", "replication_sequence": 7}
    s = store.write(elements, f"file://{tmp_path}/s", region="r", source="test", built="now", header=state, incomplete={"way": bad}, block_rows=50)
    assert {k: v for k, v in s.manifest().items()} == {"format": store.FORMAT, "region": "r", "built": "now", "source": "test", "replication_timestamp": "2024-01-01T00:00:00Z", "replication_sequence": "7", "blocks": "29", "nodes": "399", "ways": "1000", "relations": "2", "incomplete_ways": "2"}
    assert sorted((r.type, r.id, r.name) for r in s.elements.collect()) == sorted((r.type, r.id, r.name) for r in elements.collect())
    assert store.order_breaks(s.index).count() == 0 and s.index.agg(F.sum("n")).first()[0] == 1401
    wanted = spark.createDataFrame([("node", 16), ("node", 17), ("way", -2993), ("way", -2993), ("relation", 10**12), ("relation", 6), ("node", 10**9)], "type string, id long")
    found = s.fetch(wanted)
    assert sorted((r.type, r.id, r.name) for r in found.collect()) == [("node", 16, "node 16"), ("relation", 10**12, f"relation {10**12}"), ("way", -2993, "way -2993")]
    assert 0 < len(s.fetch(wanted.where("type = 'way'")).inputFiles()) < len(s.elements.inputFiles()) or len(s.elements.inputFiles()) == 1
    assert s.fetch(wanted.where("id = 6")).count() == 0
    # A file's rows are in order, so that its row groups can be passed over.
    for (file,) in s.index.select("file").distinct().collect():
        ids = [(store.TYPES.index(r.type), r.id) for r in spark.read.parquet(f"file://{tmp_path}/s/elements/{file}").collect()]
        assert ids == sorted(ids)


def test_refused(spark, tmp_path):
    for i, rows in enumerate([[("node", 1), ("node", 1)], [("area", 1)], [("way", None)]]):
        with pytest.raises(ValueError):
            store.write(spark.createDataFrame(rows, "type string, id long"), f"file://{tmp_path}/x{i}")
    empty = store.write(spark.createDataFrame([], "type string, id long"), f"file://{tmp_path}/empty")
    assert empty.elements.count() == 0 and empty.manifest()["nodes"] == "0"


def test_manifest_lines():
    assert store.parse_manifest("# c\n\na = 1\nb=x=y\n") == {"a": "1", "b": "x=y"}
    with pytest.raises(ValueError):
        store.parse_manifest("nothing")


def test_count_below(spark):
    edges = [-5, 0, 0, 3, 10]
    rows = spark.createDataFrame([(i,) for i in [-6, -5, 0, 1, 3, 4, 11, None]], "v long").select("v", count_below(F.col("v"), edges).alias("n")).collect()
    assert all(r.n == (None if r.v is None else sum(x < r.v for x in edges)) for r in rows)
    assert spark.range(1).select(count_below(F.col("id"), []).alias("n")).first().n == 0
