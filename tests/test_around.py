import math
import random

from quadrille.functions.geo import EARTH_RADIUS
from quadrille.operators.select import around_pairs


def metres(a, b):
    (lon1, lat1), (lon2, lat2) = ([math.radians(x) for x in p] for p in (a, b))
    h = math.sin((lat2 - lat1) / 2) ** 2 + math.cos(lat1) * math.cos(lat2) * math.sin((lon2 - lon1) / 2) ** 2
    return 2 * EARTH_RADIUS * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def test_pairs_near_poles_and_across_the_meridian(spark):
    r = random.Random(4)
    points = [(0.0, 90.0), (180.0, 0.0), (-180.0, 0.0)]
    for lon, lat in ((11.0, 49.4), (20.0, 85.0), (-70.0, -88.0), (180.0, 10.0), (180.0, 85.0), (0.0, 89.999)):
        wide = 0.01 / max(math.cos(math.radians(lat)), 1e-4)
        for _ in range(30):
            x = lon + r.uniform(-wide, wide)
            points.append(((x + 180) % 360 - 180, min(90.0, lat + r.uniform(-0.01, 0.01))))
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "id long, lon double, lat double")
    got = [(x.left_id, x.right_id) for x in around_pairs(df, df, 500.0).collect()]
    want = {(i, j) for i, a in enumerate(points) for j, b in enumerate(points) if metres(a, b) <= 500}
    assert len(got) == len(set(got)) and set(got) == want


def test_multiplied_rows_are_not_taken_for_few(spark):
    """Right rows stand in several cubes each: they are broadcast by their real size only, as all of a broadcast passes through the driver."""
    points = spark.range(4000).selectExpr("id", "id * 0.01 AS lon", "id * 0.02 AS lat")
    key = "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(key, "200KB")
    try:
        found = around_pairs(points, points, 500.0)
        found.collect()
        final = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert "BroadcastHashJoin" not in final
    finally:
        spark.conf.unset(key)
