"""Graph patterns over triples as DataFrame joins.

A pattern's variables are columns; a solution is a row. Constants become
filters on the scan, shared variables become equi-join keys, and Spark orders
the joins. OPTIONAL is a left join, MINUS and NOT EXISTS anti joins, EXISTS a
semi join, UNION a union by name, and grouping, ordering and slicing are the
DataFrame's own.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.tables import materialize


def match(triples: DataFrame, s: str, p: str, o: str, also: Sequence[str] = ()) -> DataFrame:
    """Solutions of one pattern; terms that begin with ``?`` are variables, others constants. ``also`` names columns to keep beside."""
    out, names = triples, {}
    for column, term in (("s", s), ("p", p), ("o", o)):
        if not term.startswith("?"):
            out = out.where(F.col(column) == term)
        elif term[1:] in names:
            out = out.where(F.col(column) == F.col(names[term[1:]]))
        else:
            names[term[1:]] = column
    return out.select(*[F.col(c).alias(n) for n, c in names.items()], *also)


def shared(a: DataFrame, b: DataFrame) -> list[str]:
    return [c for c in a.columns if c in b.columns]


def every(triples: DataFrame, *patterns: tuple[str, str, str]) -> DataFrame:
    """Solutions of all patterns together; each must share a variable with those before it."""

    def join(a: DataFrame, b: DataFrame) -> DataFrame:
        if not (on := shared(a, b)):
            raise ValueError("patterns without a shared variable multiply all solutions")
        return a.join(b, on)

    return reduce(join, [match(triples, *x) for x in patterns])


def _cases(a: DataFrame, b: DataFrame, unbound: Sequence[str]) -> Iterator[tuple[list[str], DataFrame, DataFrame]]:
    """(variables bound on both sides, rows of ``a``, rows of ``b``) for each way in which the shared variables of ``unbound`` can be bound or not.

    Two solutions are compatible if they agree where both are bound. Each case is an equi-join; a variable outside of
    ``unbound`` is taken to be always bound.
    """
    on = shared(a, b)
    open_ = [v for v in on if v in unbound]
    fixed = [v for v in on if v not in unbound]

    def rows(df: DataFrame, bound: Sequence[bool]) -> DataFrame:
        for v, is_bound in zip(open_, bound):
            df = df.where(F.col(v).isNotNull() if is_bound else F.col(v).isNull())
        return df

    for left in product((True, False), repeat=len(open_)):
        for right in product((True, False), repeat=len(open_)):
            keys = fixed + [v for v, x, y in zip(open_, left, right) if x and y]
            yield keys, rows(a, left), rows(b, right)


def compatible(a: DataFrame, b: DataFrame, unbound: Sequence[str] = ()) -> DataFrame:
    """Solutions of ``a`` and ``b`` together. ``unbound`` names the shared variables that may be null, which agree with anything."""
    if not shared(a, b):
        raise ValueError("solutions without a shared variable multiply")
    names = [*a.columns, *[c for c in b.columns if c not in a.columns]]
    parts = []
    for keys, left, right in _cases(a, b, unbound):
        if not keys:
            raise ValueError("a shared variable must always be bound")
        both = [v for v in shared(a, b) if v not in keys]
        joined = left.join(right.withColumnsRenamed({v: f"_{v}" for v in both}), keys)
        parts.append(joined.select(*[F.coalesce(c, f"_{c}").alias(c) if c in both else F.col(c) for c in names]))
    return reduce(DataFrame.union, parts)


def _incompatible(a: DataFrame, b: DataFrame, unbound: Sequence[str], all_apart: bool) -> DataFrame:
    """The rows of ``a`` that no row of ``b`` is compatible with; ``all_apart``: nor is one that shares no bound variable."""
    open_ = [v for v in shared(a, b) if v in unbound]
    out = []
    for left in product((True, False), repeat=len(open_)):
        rows = a
        for v, is_bound in zip(open_, left):
            rows = rows.where(F.col(v).isNotNull() if is_bound else F.col(v).isNull())
        for right in product((True, False), repeat=len(open_)):
            other = b
            for v, is_bound in zip(open_, right):
                other = other.where(F.col(v).isNotNull() if is_bound else F.col(v).isNull())
            keys = [v for v in shared(a, b) if v not in open_] + [v for v, x, y in zip(open_, left, right) if x and y]
            if keys:
                rows = rows.join(other, keys, "left_anti")
            elif not all_apart:
                raise ValueError("a shared variable must always be bound")
        out.append(rows.select(*a.columns))  # a join moves its keys to the front
    return reduce(DataFrame.union, out)


def optional(a: DataFrame, b: DataFrame, unbound: Sequence[str] = ()) -> DataFrame:
    """``a``, with ``b`` where it is compatible. ``unbound``: see ``compatible``."""
    if not unbound:
        return a.join(b, shared(a, b), "left")
    return compatible(a, b, unbound).unionByName(_incompatible(a, b, unbound, False), allowMissingColumns=True)


def minus(a: DataFrame, b: DataFrame, unbound: Sequence[str] = ()) -> DataFrame:
    """``a`` without what ``b`` has compatible solutions to that share a bound variable."""
    on = shared(a, b)
    if unbound and on:
        return _incompatible(a, b, unbound, True)
    return a.join(b, on, "left_anti") if on else a


def exists(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, shared(a, b), "left_semi")


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    """A variable that only one side has is unbound in the other's solutions."""
    return a.unionByName(b, allowMissingColumns=True)


def path_plus(edges: DataFrame) -> DataFrame:
    """(s, o): pairs joined by one or more edges (s, o); cycles end, as only new pairs move on."""
    edges = edges.select("s", "o").distinct()
    seen = frontier = materialize(edges)
    while not frontier.isEmpty():
        step = frontier.select("s", F.col("o").alias("m")).join(edges.select(F.col("s").alias("m"), "o"), "m").select("s", "o").distinct()
        frontier = materialize(step.join(seen, ["s", "o"], "left_anti"))
        seen = seen.union(frontier)
    return seen


def construct(solutions: DataFrame, *template: tuple[str, str, str]) -> DataFrame:
    """(s, p, o) of a template's triples for each solution, once each; unbound ones are left out."""
    term = lambda x: F.col(x[1:]).cast("string") if x.startswith("?") else F.lit(x)
    rows = F.array(*[F.struct(term(s).alias("s"), term(p).alias("p"), term(o).alias("o")) for s, p, o in template])
    return solutions.select(F.explode(rows).alias("t")).select("t.*").where("s is not null and p is not null and o is not null").distinct()


def describe(triples: DataFrame, resources: DataFrame, blank: Column | None = None) -> DataFrame:
    """All triples of resources (column s), and of the blank nodes that these lead to, cycles included.

    ``blank`` tells an object's blank nodes; by default they begin with ``_:``. The frontier of blank nodes moves until
    it meets none that is new.
    """
    blank = F.col("o").startswith("_:") if blank is None else blank
    found = materialize(triples.join(resources.select("s").distinct(), "s", "left_semi"))
    parts, seen = [found], resources.select("s").distinct()
    frontier = materialize(found.where(blank).select(F.col("o").alias("s")).distinct().join(seen, "s", "left_anti"))
    while not frontier.isEmpty():
        seen = seen.union(frontier)
        found = materialize(triples.join(frontier, "s", "left_semi"))
        parts.append(found)
        frontier = materialize(found.where(blank).select(F.col("o").alias("s")).distinct().join(seen, "s", "left_anti"))
    return reduce(DataFrame.union, parts)


class Dataset:
    """A default graph, the merge of some named ones, and the named graphs that GRAPH sees, of quads (g, s, p, o, ...)."""

    def __init__(self, quads: DataFrame, default: Sequence[str] = (), named: Sequence[str] = (), base: str = ""):
        """``default`` and ``named`` are the names in FROM and FROM NAMED: one at least, and all below ``base``."""
        if not default and not named:
            raise ValueError("at least one graph must be named")
        if outside := [g for g in (*default, *named) if not g.startswith(base)]:
            raise ValueError(f"graphs that aren't ours: {outside}")
        of = lambda names: quads.where(F.col("g").isin(*names) if names else F.lit(False))
        self.default = of(default).drop("g").distinct()
        self.named = of(named).distinct()

    def graph(self, name: str, *patterns: tuple[str, str, str]) -> DataFrame:
        """Solutions of patterns within one named graph; a name that begins with ``?`` is a variable, so each graph is searched by itself."""
        if not name.startswith("?"):
            return every(self.named.where(F.col("g") == name).drop("g"), *patterns)
        g = name[1:]
        if any(name in p for p in patterns):
            raise ValueError("the graph's variable can't be a term's, too")
        each = [match(self.named.withColumn("_g", F.col("g")), *p, also=("_g",)).withColumnRenamed("_g", g) for p in patterns]
        return reduce(lambda a, b: a.join(b, shared(a, b)), each)
