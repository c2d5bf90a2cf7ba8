import pytest

from quadrille.operators.rdf import ntriples
from quadrille.plans import graph


@pytest.fixture(scope="module")
def triples(spark):
    rows = [("a", "knows", "b"), ("b", "knows", "c"), ("c", "knows", "a"), ("c", "knows", "d"), ("a", "name", "A"), ("b", "name", "B"), ("d", "age", "7"), ("e", "knows", "e")]
    return spark.createDataFrame(rows, "s string, p string, o string")


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_patterns(triples):
    assert rows(graph.every(triples, ("?x", "knows", "?y"), ("?y", "name", "?n")).select("x", "y", "n")) == [("a", "b", "B"), ("c", "a", "A")]
    assert rows(graph.match(triples, "?x", "knows", "?x")) == [("e",)]
    assert rows(graph.match(triples, "a", "?p", "?o")) == [("knows", "b"), ("name", "A")]
    with pytest.raises(ValueError):
        graph.every(triples, ("?x", "knows", "?y"), ("?z", "age", "?n"))


def test_optional_minus_exists_union(triples):
    knows, name = graph.match(triples, "?x", "knows", "?y"), graph.match(triples, "?x", "name", "?n")
    assert rows(graph.optional(knows, name).select("x", "n")) == [("a", "A"), ("b", "B"), ("c", None), ("c", None), ("e", None)]
    assert rows(graph.minus(knows, name).select("x")) == [("c",), ("c",), ("e",)]
    assert rows(graph.exists(knows, name).select("x")) == [("a",), ("b",)]
    assert graph.minus(knows, graph.match(triples, "?q", "age", "?r")).count() == 5
    assert rows(graph.union(name.select("n"), graph.match(triples, "?x", "age", "?g").select("g"))) == [("A", None), ("B", None), (None, "7")]


def test_paths_end_in_cycles(triples):
    got = rows(graph.path_plus(graph.match(triples, "?s", "knows", "?o")))
    assert got == sorted([(x, y) for x in "abc" for y in "abcd"] + [("e", "e")])


def test_construct_and_describe(triples):
    found = graph.optional(graph.match(triples, "?x", "knows", "?y"), graph.match(triples, "?x", "name", "?n"))
    assert rows(graph.construct(found, ("?y", "known", "yes"), ("?x", "called", "?n"))) == [("a", "called", "A"), ("a", "known", "yes"), ("b", "called", "B"), ("b", "known", "yes"), ("c", "known", "yes"), ("d", "known", "yes"), ("e", "known", "yes")]
    assert graph.describe(triples, graph.match(triples, "?s", "name", "B")).count() == 2


def test_ntriples(spark):
    t = spark.createDataFrame([("/n/1", "geo:lat", 'a"\\\n', "literal", "xsd:decimal"), ("/n/1", "/tag/x y", "/n/2", "iri", None)], "s string, p string, o string, o_kind string, o_datatype string")
    assert [r.value for r in ntriples(t, "http://h").orderBy("value").collect()] == [
        "<http://h/n/1> <http://h/tag/x%20y> <http://h/n/2> .",
        r'<http://h/n/1> <http://www.w3.org/2003/01/geo/wgs84_pos#lat> "a\"\\\n"^^<http://www.w3.org/2001/XMLSchema#decimal> .',
    ]
