import pytest

from quadrille.operators import closure
from quadrille.sources.elements import Elements


@pytest.fixture(scope="module")
def make(spark):
    def make(nodes, ways, relations):
        table = lambda rows, schema: spark.createDataFrame(rows, schema)
        none = table([], "id long, seq int, k string, v string")
        return Elements(
            nodes=table([(i, 0.0, 0.0) for i in nodes], "id long, lat double, lon double"), node_tags=none,
            ways=table([(i,) for i in ways], "id long"), way_tags=none,
            way_nodes=table([(i, s, n) for i, refs in ways.items() for s, n in enumerate(refs)], "way_id long, seq long, node_id long"),
            relations=table([(i,) for i in relations], "id long"), relation_tags=none,
            relation_members=table([(i, s, t, m, "") for i, members in relations.items() for s, (t, m) in enumerate(members)], "rel_id long, seq long, type string, ref long, role string"),
            changesets=none,
        )

    return make


WAYS = {10: [1, 2, 3, 1], 11: [3, 4], 12: [1, 9], 13: []}
RELATIONS = {
    100: [("way", 10), ("node", 5), ("way", 10)],  # complete
    101: [("way", 12)],  # a node of its way is missing
    102: [("way", 99)],  # its way is missing
    103: [("node", 9)],
    104: [("relation", 104), ("relation", 101), ("way", 11)],  # itself, and one that is incomplete in itself
    105: [("relation", 999)],
    106: [],
    107: [("way", 13)],  # a way without nodes has no place
    108: [("area", 1)],
}
START = [("relation", i) for i in [*RELATIONS, 999]] + [("way", i) for i in (10, 11, 12, 13, 99)] + [("node", 1), ("node", 9), ("area", 1)]


def test_complete_answers_only(spark, make):
    e = make([1, 2, 3, 4, 5], WAYS, RELATIONS)
    start = spark.createDataFrame(START + START, "type string, id long")
    fine = sorted(map(tuple, closure.complete(e, start).collect()))
    assert fine == [("node", 1), ("relation", 100), ("relation", 104), ("relation", 106), ("way", 10), ("way", 11)]
    rows = closure.full_complete(e, start).collect()
    got = {}
    for r in rows:
        got.setdefault((r.of_type, r.of_id), []).append((r.type, r.id))
    assert {k: sorted(v) for k, v in got.items()} == {
        ("node", 1): [("node", 1)],
        ("way", 10): [("node", 1), ("node", 2), ("node", 3), ("way", 10)],
        ("way", 11): [("node", 3), ("node", 4), ("way", 11)],
        ("relation", 100): [("node", 1), ("node", 2), ("node", 3), ("node", 5), ("relation", 100), ("way", 10)],
        ("relation", 104): [("node", 3), ("node", 4), ("relation", 101), ("relation", 104), ("way", 11)],
        ("relation", 106): [("relation", 106)],
    }


def test_regions_fall_back_to_the_first_complete_one(spark, make):
    small = make([1, 2, 3], {10: WAYS[10]}, {100: RELATIONS[100], 101: RELATIONS[101]})
    large = make([1, 2, 3, 4, 5], WAYS, RELATIONS)
    start = spark.createDataFrame([("relation", 100), ("relation", 101), ("way", 10), ("way", 11), ("node", 9)], "type string, id long")
    got = {(r.type, r.id): r.region for r in closure.first_complete_region([small, large], start).collect()}
    assert got == {("relation", 100): 1, ("relation", 101): None, ("way", 10): 0, ("way", 11): 1, ("node", 9): None}
    full = closure.fallback_full([small, large], start)
    assert {(r.of_type, r.of_id, r.region) for r in full.collect()} == {("relation", 100, 1), ("way", 10, 0), ("way", 11, 1)}
    assert full.count() == full.distinct().count() == 6 + 4 + 3
