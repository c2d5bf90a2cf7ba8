import random
from functools import reduce

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.plans import graph
from quadrille.plans.paths import Either, Inverse, Not, P, Repeated, Sequence, pairs

ROWS = [("a", "p", "b"), ("b", "p", "c"), ("c", "p", "a"), ("c", "q", "d"), ("d", "q", "d"), ("e", "r", "a"), ("a", "q", "e"), ("f", "r", "f"), ("b", "q", "b")]


@pytest.fixture(scope="module")
def triples(spark):
    return spark.createDataFrame(ROWS, "s string, p string, o string")


def brute(path, rows, back=False):
    """Pairs in a list: bags, but sets where a part repeats."""
    if isinstance(path, Inverse):
        return brute(path.part, rows, not back)
    if isinstance(path, P):
        return [(o, s) if back else (s, o) for s, p, o in rows if p == path.name]
    if isinstance(path, Not):
        ahead = [(s, o) for s, p, o in rows if path.ahead and p not in path.forward]
        behind = [(o, s) for s, p, o in rows if path.backward and p not in path.backward]
        return [(o, s) if back else (s, o) for s, o in ahead + behind]
    if isinstance(path, Either):
        return [x for part in path.parts for x in brute(part, rows, back)]
    if isinstance(path, Sequence):
        one, two = (brute(x, rows, back) for x in (reversed(path.parts) if back else path.parts))
        return [(s, z) for s, m in one for n, z in two if m == n]
    step = set(brute(path.part, rows, back))
    found = set(step)
    while path.many and (more := {(s, z) for s, m in found for n, z in step if m == n} - found):
        found |= more
    return list(found | ({(n, n) for s, _, o in rows for n in (s, o)} if path.none else set()))


p, q, r = P("p"), P("q"), P("r")
#: Without a part that repeats, and with.
PLAIN = [p / q, p | q, ~p, ~(p / q), ~(p | ~q), Not("p"), Not(~p), Not("p", ~q), ~Not("p", "r")]
CASES = [p.opt(), (p | q).plus(), (p / q.star()) / ~r, (p.opt() / q).plus(), (~(p / q)).plus(), (p / p / Not("p").star()).star()]


@pytest.mark.parametrize("path", CASES, ids=range(len(CASES)))
def test_paths(triples, path):
    assert sorted(map(tuple, pairs(triples, path).collect())) == sorted(brute(path, ROWS))


def test_plain_paths(triples):
    tables = [pairs(triples, path).select(F.lit(i).alias("i"), "s", "o") for i, path in enumerate(PLAIN)]
    got = sorted(map(tuple, reduce(DataFrame.union, tables).collect()))
    assert got == sorted((i, *x) for i, path in enumerate(PLAIN) for x in brute(path, ROWS))


def test_starts_and_no_length(spark, triples):
    starts = spark.createDataFrame([("a",), ("z",), ("a",)], "n string")
    assert sorted(map(tuple, pairs(triples, p.star(), starts).collect())) == [("a", "a"), ("a", "b"), ("a", "c"), ("z", "z")]
    assert sorted(map(tuple, pairs(triples, p / q, starts).collect())) == [("a", "b")]
    assert pairs(triples.limit(0), p.star()).count() == 0
    assert [tuple(x) for x in pairs(triples.limit(0), p.star(), starts.where("n = 'z'")).collect()] == [("z", "z")]


def test_long_cycle(spark):
    rows = [(f"n{i}", "p", f"n{(i + 1) % 8}") for i in range(8)]
    got = pairs(spark.createDataFrame(rows, "s string, p string, o string"), (p / p / p).plus())
    assert got.count() == 64 == got.distinct().count()


# Solutions with unbound variables ----------------------------------------------


def solutions(spark, rows, names):
    return spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))


def agree(x, y):
    return all(x[v] is None or y[v] is None or x[v] == y[v] for v in x.keys() & y.keys())


def merged(x, y):
    return {v: x.get(v) if x.get(v) is not None else y.get(v) for v in x.keys() | y.keys()}


def test_unbound_variables_agree_with_anything(spark):
    rng = random.Random(1)
    make = lambda names, n: [tuple(rng.choice("ab") if v == "k" else rng.choice(["x", "y", None]) for v in names) for _ in range(n)]
    a_rows, b_rows = make("kuva", 25), make("kuvb", 9)
    a, b = solutions(spark, a_rows, "kuva").select("a", "v", "k", "u"), solutions(spark, b_rows, "kuvb")
    xs, ys = [dict(zip("kuva", r)) for r in a_rows], [dict(zip("kuvb", r)) for r in b_rows]
    key = lambda d: tuple(str(d.get(v)) for v in "kuvab")
    got = lambda df: sorted(key(r.asDict()) for r in df.collect())
    assert got(graph.compatible(a, b, ["u", "v"])) == sorted(key(merged(x, y)) for x in xs for y in ys if agree(x, y))
    left = [merged(x, y) for x in xs for y in ys if agree(x, y)] + [x for x in xs if not any(agree(x, y) for y in ys)]
    assert got(graph.optional(a, b, ["u", "v"])) == sorted(map(key, left))
    shares = lambda x, y: any(x[v] is not None and y[v] is not None for v in x.keys() & y.keys())
    assert got(graph.minus(a, b, ["u", "v"])) == sorted(key(x) for x in xs if not any(agree(x, y) and shares(x, y) for y in ys))
    # Where every shared variable may be unbound, MINUS still has a meaning; a join would multiply.
    c, d = a.select("u", "a"), b.select("u", "b")
    assert got(graph.minus(c, d, ["u"])) == sorted(key({"u": x["u"], "a": x["a"]}) for x in xs if not any(x["u"] is not None and x["u"] == y["u"] for y in ys))
    with pytest.raises(ValueError):
        graph.compatible(c, d, ["u"])


# Descriptions and datasets -----------------------------------------------------


def test_describe_follows_blank_nodes(spark):
    rows = [("x", "p", "_:1"), ("_:1", "q", "_:2"), ("_:2", "q", "_:1"), ("_:2", "r", "y"), ("y", "p", "z"), ("w", "p", "_:3"), ("_:3", "p", "v"), ("x", "p", "y")]
    t = spark.createDataFrame(rows, "s string, p string, o string")
    got = graph.describe(t, spark.createDataFrame([("x",), ("x",), ("none",)], "s string"))
    assert sorted(map(tuple, got.collect())) == sorted(rows[:4] + rows[-1:])


def test_datasets(spark):
    rows = [("g1", "a", "p", "b"), ("g1", "b", "p", "c"), ("g2", "a", "p", "b"), ("g2", "b", "q", "c"), ("g3", "b", "p", "d")]
    quads = spark.createDataFrame(rows, "g string, s string, p string, o string")
    d = graph.Dataset(quads, default=["g1", "g2"], named=["g1", "g2"])
    assert sorted(map(tuple, d.default.collect())) == [("a", "p", "b"), ("b", "p", "c"), ("b", "q", "c")]
    assert sorted(map(tuple, d.graph("g1", ("?x", "p", "?y"), ("?y", "p", "?z")).select("x", "y", "z").collect())) == [("a", "b", "c")]
    assert d.graph("g3", ("?x", "p", "?y")).count() == 0  # not named
    got = d.graph("?g", ("?x", "p", "?y"), ("?y", "q", "?z"))
    assert sorted(tuple(r[c] for c in ("g", "x", "y", "z")) for r in got.collect()) == [("g2", "a", "b", "c")]
    assert graph.Dataset(quads, named=["g1"]).default.count() == 0
    with pytest.raises(ValueError):
        graph.Dataset(quads)
    with pytest.raises(ValueError):
        graph.Dataset(quads, default=["https://elsewhere/g"], base="https://ours/")
    with pytest.raises(ValueError):
        d.graph("?g", ("?g", "p", "?y"))
