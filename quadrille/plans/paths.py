"""Paths between nodes of a graph, built from steps.

    P("knows") / P("name")      one after the other        ~P("knows")    the other way round
    P("a") | P("b")             either                     P("a").plus()  one or more, .star() any number, .opt() none or one
    Not("a", ~P("b"))           one step of another predicate, forwards or (where inverse ones are named) backwards

Sequences, alternatives and inverses are joins and unions: a pair of nodes
occurs once for each way to it. A part under ``star``, ``plus`` or ``opt`` is
compiled to an automaton whose states stand beside the nodes that the search has
reached; each round joins the frontier with the edges of its states and drops
what was met before, so cycles end and a pair occurs once. Paths of no length
hold for every node of the graph.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.tables import materialize


class Path:
    def __truediv__(self, other: Path) -> Path:
        return Sequence((self, other))

    def __or__(self, other: Path) -> Path:
        return Either((self, other))

    def __invert__(self) -> Path:
        return Inverse(self)

    def plus(self) -> Path:
        return Repeated(self, False, True)

    def star(self) -> Path:
        return Repeated(self, True, True)

    def opt(self) -> Path:
        return Repeated(self, True, False)


@dataclass(frozen=True)
class P(Path):
    """A step along a predicate."""

    name: str


@dataclass(frozen=True)
class Sequence(Path):
    parts: tuple[Path, ...]


@dataclass(frozen=True)
class Either(Path):
    parts: tuple[Path, ...]


@dataclass(frozen=True)
class Inverse(Path):
    part: Path


@dataclass(frozen=True)
class Repeated(Path):
    part: Path
    none: bool
    many: bool


@dataclass(frozen=True, init=False)
class Not(Path):
    """A step along a predicate that isn't named."""

    forward: tuple[str, ...]
    backward: tuple[str, ...]
    ahead: bool

    def __init__(self, *names: str | P | Inverse):
        plain = [n if isinstance(n, str) else n.name for n in names if not isinstance(n, Inverse)]
        object.__setattr__(self, "forward", tuple(plain))
        object.__setattr__(self, "backward", tuple(n.part.name for n in names if isinstance(n, Inverse)))
        object.__setattr__(self, "ahead", bool(plain) or not self.backward)


@dataclass(frozen=True)
class _Edge:
    """Triples whose predicate is one of ``names``, or none of them, in one direction."""

    names: tuple[str, ...]
    negated: bool
    back: bool

    def where(self) -> Column:
        named = F.col("p").isin(*self.names)
        return ~named if self.negated else named


def _edges(path: Path, back: bool) -> list[_Edge]:
    if isinstance(path, P):
        return [_Edge((path.name,), False, back)]
    out = [_Edge(path.forward, True, back)] if path.ahead else []
    return out + ([_Edge(path.backward, True, not back)] if path.backward else [])


@dataclass
class Automaton:
    """States 0 to ``size`` - 1 from ``start`` to ``end``, moves by edges (state, edge, state) and for nothing (state, state)."""

    size: int = 0
    moves: list[tuple[int, _Edge, int]] = field(default_factory=list)
    free: list[tuple[int, int]] = field(default_factory=list)
    start: int = 0
    end: int = 0

    def new(self) -> int:
        self.size += 1
        return self.size - 1

    def add(self, path: Path, back: bool = False) -> tuple[int, int]:
        """The first and last state of a part."""
        if isinstance(path, Inverse):
            return self.add(path.part, not back)
        if isinstance(path, (P, Not)):
            a, z = self.new(), self.new()
            self.moves += [(a, e, z) for e in _edges(path, back)]
            return a, z
        if isinstance(path, Sequence):
            parts = [self.add(x, back) for x in (reversed(path.parts) if back else path.parts)]
            self.free += [(x[1], y[0]) for x, y in zip(parts, parts[1:])]
            return parts[0][0], parts[-1][1]
        a, z = self.new(), self.new()
        for first, last in [self.add(x, back) for x in (path.parts if isinstance(path, Either) else (path.part,))]:
            self.free += [(a, first), (last, z)]
            if isinstance(path, Repeated) and path.many:
                self.free.append((last, first))
        if isinstance(path, Repeated) and path.none:
            self.free.append((a, z))
        return a, z

    def reach(self, state: int) -> set[int]:
        """What a state reaches for nothing, itself included."""
        seen, waiting = {state}, [state]
        while waiting:
            at = waiting.pop()
            for a, z in self.free:
                if a == at and z not in seen:
                    seen.add(z)
                    waiting.append(z)
        return seen


def compiled(path: Path) -> Automaton:
    out = Automaton()
    out.start, out.end = out.add(path)
    return out


def nodes_of(triples: DataFrame) -> DataFrame:
    """(n) of all subjects and objects, once each."""
    return triples.select(F.col("s").alias("n")).union(triples.select("o")).distinct()


def _step(triples: DataFrame, e: _Edge) -> DataFrame:
    found = triples.where(e.where())
    return found.select(F.col("o").alias("s"), F.col("s").alias("o")) if e.back else found.select("s", "o")


def _searched(triples: DataFrame, path: Repeated, starts: DataFrame | None, back: bool) -> DataFrame:
    """(s, o), once each, of a part that repeats; ``starts`` (n) are the nodes to begin with, by default all."""
    machine = compiled(Inverse(path) if back else path)
    begins, whole = machine.reach(machine.start), {s: machine.reach(s) for s in range(machine.size)}
    # A move leads to every state that its end reaches for nothing and that moves on or is the end.
    live = {a for a, _, _ in machine.moves} | {machine.end}
    parts = [_step(triples, e).select(F.lit(a).alias("state"), F.col("s").alias("node"), F.lit(n).alias("to_state"), F.col("o").alias("to")) for a, e, z in machine.moves for n in sorted(whole[z] & live)]
    edges = materialize(reduce(DataFrame.union, parts).distinct())
    first = [s for s in sorted(begins & live)]
    roots = nodes_of(triples) if starts is None else starts.select("n").distinct()
    if starts is None and machine.end not in begins:  # only nodes that an edge leaves
        roots = edges.where(F.col("state").isin(*first)).select(F.col("node").alias("n")).distinct()
    frontier = materialize(roots.select(F.col("n").alias("s"), F.explode(F.array(*map(F.lit, first))).alias("state"), F.col("n").alias("node")))
    seen = frontier
    while not frontier.isEmpty():
        step = frontier.join(edges, ["state", "node"]).select("s", F.col("to_state").alias("state"), F.col("to").alias("node")).distinct()
        frontier = materialize(step.join(seen, ["s", "state", "node"], "left_anti"))
        seen = seen.union(frontier)
    return seen.where(F.col("state") == machine.end).select("s", F.col("node").alias("o"))


def pairs(triples: DataFrame, path: Path, starts: DataFrame | None = None, back: bool = False) -> DataFrame:
    """(s, o) of the pairs of nodes that a path joins, in triples (s, p, o).

    ``starts`` (n) restricts the first node; it also belongs to the graph then, so a path of no length holds for it.
    """
    if isinstance(path, Inverse):
        return pairs(triples, path.part, starts, not back)
    if isinstance(path, Repeated):
        return _searched(triples, path, starts, back)
    kept = (lambda df: df) if starts is None else (lambda df: df.join(starts.select(F.col("n").alias("s")).distinct(), "s", "left_semi"))
    if isinstance(path, (P, Not)):
        return kept(reduce(DataFrame.union, [_step(triples, e) for e in _edges(path, back)]))
    if isinstance(path, Either):
        return reduce(DataFrame.union, [pairs(triples, x, starts, back) for x in path.parts])
    parts = list(reversed(path.parts)) if back else list(path.parts)
    out = pairs(triples, parts[0], starts, back)
    for x in parts[1:]:
        out = materialize(out)
        onward = pairs(triples, x, out.select(F.col("o").alias("n")), back)
        out = out.select("s", F.col("o").alias("m")).join(onward.select(F.col("s").alias("m"), "o"), "m").select("s", "o")
    return out
