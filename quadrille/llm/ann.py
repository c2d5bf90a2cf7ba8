"""Approximate nearest neighbours by multiprobe p-stable hashing.

Entries are dealt to ranges of norms (each half as wide again as the next) and
scaled by their range's largest norm, so that unequal norms don't crowd. One
more component lifts them to the unit sphere, where the largest inner product
is the smallest distance. Each table hashes an entry to the floors of a few
random projections. A query visits in each table the buckets in the order of
their estimated success: the chance that a neighbour at a usual distance falls
between the steps on either side. The numbers of projections and of probes grow
with a range's entries, with no switch to another way at any size.

How many probes it takes depends on the data, so it is measured: the true
neighbours of a bounded sample of queries (``SAMPLED``) are found by comparing
these with all entries, and in each range the probes grow, and then the
projections shrink, until ``TARGET`` of the sample's neighbours there lie in
visited buckets. With one projection left nearly every bucket is visited, so this
ends for any data. All entries are indexed.

An entry goes to each table with its vector, and a query goes once to each group
of buckets (those that share their first steps) with its vector and the list of
buckets that it visits there. Entries in visited buckets are compared in double
precision (a rounded code can't tell near copies apart), the best of all tables
are merged, and these are ranked by the exact inner product, summed in order.
A query that finds too few is compared with all entries, in blocks.

Work stays even: equal vectors are one entry with its smallest ids (as many as
can be in a result), and crowded groups are cut into cells of bounded size on
both sides.

Defined cases: vectors that are null, zero, of another length than most, or that
hold null or non-finite components take no part, nor do rows without an id, as a
result can't name them; an id names one vector, so rows that repeat an id are
one row (if their vectors differ, the least in array order stands for it); ties
go to the smaller id; extra columns play no part; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from quadrille.llm.common import materialize

TABLES = 4
#: Width of a step, where projections of the unit sphere have a variance of 1.
WIDTH = 2.5
#: Distance on the unit sphere at which a neighbour is expected where the sample shows none.
NEAR = 1.05
#: Queries whose true neighbours are looked up, the share of these that a range must find, and how often its probes double before projections go.
SAMPLED, TARGET, DOUBLINGS = 128, 0.95, 2
#: Steps to either side that a probe may take in a projection.
OFFSETS = np.arange(-2, 3)
SEED = 20
#: Ranges of norms; the last one holds all that are smaller still.
RANGES = 16
#: Entries, or visiting queries, of a group of buckets from which it is cut into cells.
CELL_ROWS = 16384
#: Entries ranked exactly beyond those wanted, as sums in another order differ in the last bits.
SLACK = 8
#: Pairs of vectors that are multiplied at once, and the share of all pairs from which a cell is multiplied as a whole.
PAIRS, DENSE = 1 << 15, 0.125
FOUND = ["query", "ids", "many", "near"]
CELL = "cell long, query boolean, id long, many int, vector binary, buckets array<long>"


def hash_count(n: int) -> int:
    """Projections of a table for n entries, about as many buckets as entries."""
    return max(2, round(math.log2(max(n, 1)) / 1.3))


def probe_count(n: int) -> int:
    """Buckets that a query visits in each table."""
    return max(32, math.ceil(2 * n**0.4))


def group_count(n: int) -> int:
    """First projections that the buckets of a group share: groups of about half a cell."""
    return max(1, min(hash_count(n) - 1, round(math.log2(max(1.0, 2 * n / CELL_ROWS)) / 1.3)))


def _below(z: np.ndarray) -> np.ndarray:
    """The normal distribution's function, by its logistic approximation."""
    return 1 / (1 + np.exp(-np.clip(1.702 * z, -60, 60)))


class Hashing:
    """The tables' projections for a range of norms, always the same for a size and dimension."""

    def __init__(self, number: int, n: int, dim: int, norm: float, k: int | None = None, probes: int | None = None, near: float = NEAR):
        self.number, self.norm, self.near = number, norm, near
        self.k, self.probes = k or hash_count(n), probes or probe_count(n)
        self.g = max(1, min(self.k - 1, group_count(n)))
        rng = np.random.default_rng([SEED, number])
        shape = (TABLES, dim + 1, self.k)
        self.directions = np.concatenate([self._basis(rng, dim + 1, self.k)[None] for _ in range(shape[0])]) / WIDTH
        self.shift = rng.random((TABLES, self.k))
        self.mixers = rng.integers(1, 1 << 62, (self.k,), dtype=np.int64) | 1

    @staticmethod
    def _basis(rng: np.random.Generator, dim: int, k: int) -> np.ndarray:
        """k directions, at right angles to each other as far as the dimension allows."""
        blocks = [np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(-(-k // dim))]
        return np.hstack(blocks)[:, :k] * math.sqrt(dim)

    def places(self, x: np.ndarray, query: bool) -> np.ndarray:
        """Positions (table, row, projection) in steps; queries point, entries are lifted."""
        if query:
            lifted = np.hstack([x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300), np.zeros((len(x), 1))])
        else:
            x = x / max(self.norm, 1e-300)
            lifted = np.hstack([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1, keepdims=True)))])
        return np.einsum("rd,tdk->trk", lifted, self.directions, optimize=True) + self.shift[:, None, :]

    def bucket(self, steps: np.ndarray, first: int | None = None) -> np.ndarray:
        """One number for each vector of floors (last axis); of the first ones alone it is the group's."""
        with np.errstate(over="ignore"):
            return (steps.astype(np.int64) * self.mixers)[..., :first].sum(axis=-1, dtype=np.int64)

    def visited(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Buckets and their groups (row, probe) of one table: those likeliest to hold a neighbour, likeliest first.

        The best partial choices of the first projections hold those of all:
        what is added for the others doesn't depend on them.
        """
        low = np.floor(places)
        rest, spread = places - low, self.near / WIDTH
        gain, number = np.zeros((len(places), 1)), np.zeros((len(places), 1), np.int64)
        group = number
        for j in range(self.k):
            to = OFFSETS[None, :] - rest[:, j, None]
            chance = np.log(np.maximum(_below((to + 1) / spread) - _below(to / spread), 1e-12))
            with np.errstate(over="ignore"):
                steps = (low[:, j, None].astype(np.int64) + OFFSETS) * self.mixers[j]
                number = (number[:, :, None] + steps[:, None, :]).reshape(len(places), -1)
            gain = (gain[:, :, None] + chance[:, None, :]).reshape(len(places), -1)
            group = number if j < self.g else np.repeat(group, len(OFFSETS), axis=1)
            if gain.shape[1] > self.probes:
                best = np.argpartition(-gain, self.probes - 1, axis=1)[:, : self.probes]
                gain, number, group = (np.take_along_axis(a, best, 1) for a in (gain, number, group))
        order = np.argsort(-gain, axis=1, kind="stable")
        return np.take_along_axis(number, order, 1), np.take_along_axis(group, order, 1)

    def recall(self, queries: np.ndarray, who: np.ndarray, found: np.ndarray) -> float:
        """The share of pairs (number of the query, entry) whose entry lies in a bucket that its query visits."""
        asked, at = self.places(queries, True), np.floor(self.places(found, False))
        hit = np.zeros(len(who), bool)
        for t in range(TABLES):
            hit |= (self.visited(asked[t])[0][who] == self.bucket(at[t])[:, None]).any(axis=1)
        return hit.mean()

    def table_number(self, t: int) -> int:
        return (self.number * TABLES + t) * 0x9E3779B97F4A7C1 & (1 << 62) - 1


def _matrix(column: pa.Array) -> np.ndarray:
    return np.stack(column.to_numpy(zero_copy_only=False)).astype(np.float64) if len(column) else np.zeros((0, 1))


def _bytes(x: np.ndarray, dtype: str) -> pa.Array:
    return pa.array([v.tobytes() for v in x.astype(dtype)], pa.binary())


def _dtype(df: DataFrame) -> str:
    """The numbers of the column ``vec``, as numpy names them."""
    return "f8" if isinstance(df.schema["vec"].dataType.elementType, DoubleType) else "f4"


def valid_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, vec) of the vectors that take part, one for each id."""
    v = F.col(embedding)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("vec")).where(F.coalesce(fine, F.lit(False)) & F.col("vec_id").isNotNull())
    width = rows.groupBy(F.size("vec").alias("width")).count().orderBy(F.desc("count"), "width").first()
    return rows.where(F.size("vec") == (width[0] if width else 1)).groupBy("vec_id").agg(F.min("vec").alias("vec"))


def _rows(df: DataFrame, hashings: dict[int, Hashing], query: bool, payload: bool) -> DataFrame:
    """Cells' rows before they are cut: for entries one in each table, for queries one for each group that is visited.

    Without payload the column ``cell`` alone. ``df`` has id, many, range and vec.
    """
    dtype = _dtype(df)

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                x, of_range = _matrix(batch.column(3)), batch.column(2).to_numpy()
                vector = _bytes(x, dtype) if payload else None
                for number, hashing in hashings.items():
                    mine = np.arange(len(x)) if query else np.flatnonzero(of_range == number)
                    if not len(mine):
                        continue
                    places = hashing.places(x[mine], query)
                    for t in range(TABLES):
                        salt = hashing.table_number(t)
                        if query:
                            found, group = hashing.visited(places[t])
                            row = np.repeat(np.arange(len(mine)), found.shape[1])
                            found, group = found.reshape(-1), group.reshape(-1)
                            order = np.lexsort((group, row))
                            row, found, group = row[order], found[order], group[order]
                            first = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (group[1:] != group[:-1])))
                            ends, row, group = np.append(first, len(found)), row[first], group[first]
                        else:
                            steps = np.floor(places[t])
                            found, group = hashing.bucket(steps), hashing.bucket(steps, hashing.g)
                            ends, row = np.arange(len(found) + 1), np.arange(len(found))
                        cell = pa.array(group ^ salt)
                        if not payload:
                            yield pa.RecordBatch.from_arrays([cell], ["cell"])
                            continue
                        row = mine[row]
                        take = pa.array(row)
                        yield pa.RecordBatch.from_arrays(
                            [cell, pa.array(np.full(len(row), query)), batch.column(0).take(take), batch.column(1).take(take), vector.take(take), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(found))],
                            ["cell", "query", "id", "many", "vector", "buckets"],
                        )

    return df.select("id", "many", "range", "vec").mapInArrow(run, CELL if payload else "cell long")


def _scan_rows(df: DataFrame, query: bool) -> DataFrame:
    """All rows in one bucket, for an exact scan."""
    dtype = _dtype(df)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                n = batch.num_rows
                zero = pa.array(np.zeros(n, np.int64))
                buckets = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32)), zero)
                yield pa.RecordBatch.from_arrays([zero, pa.array(np.full(n, query)), batch.column(0), batch.column(1), _bytes(_matrix(batch.column(2)), dtype), buckets], ["cell", "query", "id", "many", "vector", "buckets"])

    return df.select("id", "many", "vec").mapInArrow(run, CELL)


def _cells(rows: DataFrame, cut: DataFrame, own: str, other: str, query: bool) -> DataFrame:
    """Rows of crowded groups get a cell of their own side and a copy for each of the other side's."""
    joined = rows.join(cut, "cell", "left")
    mine = F.pmod(F.xxhash64("id"), F.coalesce(own, F.lit(1)))
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(other, F.lit(1)) - 1))
    split = joined.select(*rows.columns, mine.alias("mine"), copies.alias("theirs"))
    first, second = ("theirs", "mine") if query else ("mine", "theirs")
    return split.withColumn("cell", F.xxhash64("cell", first, second)).drop("mine", "theirs")


def _search(keep: int, dtype: str):
    """Rows come sorted by cell, its entries before its queries; a cell's entries are few."""

    def search(batches):
        cell, parts, ready = None, [], None

        def prepared():
            """The cell's entries in order of their buckets."""
            bucket, ids, many, x = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(bucket, kind="stable")
            return bucket[order], ids[order], many[order], x[order].astype(np.float64)

        def compared(ids, buckets, ends, y):
            """The best entries of each query: (queries, where their lists begin, ids, many, near)."""
            bucket, entry, many, x = ready
            a, z = np.searchsorted(bucket, buckets, "left"), np.searchsorted(bucket, buckets, "right")
            total = np.append(0, np.cumsum(z - a))[ends]  # pairs before each query
            out, at = [], 0
            while at < len(ids):
                to = max(at + 1, int(np.searchsorted(total, total[at] + PAIRS, "right")) - 1)
                s, e = ends[at], ends[to]
                n = z[s:e] - a[s:e]
                pick = np.arange(n.sum()) + np.repeat(a[s:e] - np.append(0, np.cumsum(n)[:-1]), n)
                who = np.repeat(np.arange(at, to), np.diff(total[at : to + 1]))
                if len(pick) >= DENSE * len(x) * (to - at):
                    near = (y[at:to] @ x.T)[who - at, pick]
                else:
                    near = np.einsum("pd,pd->p", x[pick], y[who])
                edges = total[at : to + 1] - total[at]
                good = np.ones(len(near), bool)
                for i in np.flatnonzero(np.diff(edges) > 8 * keep):
                    own = near[edges[i] : edges[i + 1]]
                    good[edges[i] : edges[i + 1]] = own >= np.partition(own, -keep)[-keep]
                pick, who, near = pick[good], who[good], near[good]
                order = np.lexsort((entry[pick], -near, who))
                who = who[order]
                start = np.flatnonzero(np.append(True, who[1:] != who[:-1])) if len(who) else np.zeros(0, int)
                rank = np.arange(len(who)) - np.repeat(start, np.diff(np.append(start, len(who))))
                best, who = order[rank < keep], who[rank < keep]
                first = np.flatnonzero(np.append(True, who[1:] != who[:-1])) if len(who) else np.zeros(0, int)
                out.append((ids[who[first]], np.append(first, len(who)), entry[pick[best]], many[pick[best]], near[best]))
                at = to
            return out

        for whole in batches:
            if not whole.num_rows:
                continue
            cell_of, query = whole.column(0).to_numpy(), whole.column(1).to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.append(True, (cell_of[1:] != cell_of[:-1]) | (query[1:] != query[:-1])))
            for a, z in zip(edges, [*edges[1:], len(cell_of)]):
                if cell_of[a] != cell:
                    cell, parts, ready = cell_of[a], [], None
                part = whole.slice(a, z - a)
                ids, many = (part.column(i).to_numpy() for i in (2, 3))
                x = np.frombuffer(b"".join(part.column(4).to_pylist()), dtype).reshape(z - a, -1)
                lists = part.column(5)
                if not query[a]:
                    parts.append((lists.flatten().to_numpy(), ids, many, x))
                elif parts:
                    if ready is None:
                        ready = prepared()
                    ends = np.append(0, np.cumsum(lists.value_lengths().to_numpy())).astype(np.int64)
                    for q, at, *lists in compared(ids, lists.flatten().to_numpy(), ends, x.astype(np.float64)):
                        if len(q):
                            yield pa.RecordBatch.from_arrays([pa.array(q), *[pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(x)) for x in lists]], FOUND)

    return search


def _merge(keep: int):
    """Rows of lists come sorted by query; the best of all a query's lists leave, each entry once."""

    def merge(batches):
        rest = None

        def merged(rows):
            query, lists = rows.column(0).to_numpy(), [rows.column(i) for i in (1, 2, 3)]
            who = np.repeat(query, lists[0].value_lengths().to_numpy())
            ids, many, near = (x.flatten().to_numpy() for x in lists)
            order = np.lexsort((-near, ids, who))  # a score may differ in its last bits with the order of its sum
            who, ids, many, near = (x[order] for x in (who, ids, many, near))
            once = np.append(True, (who[1:] != who[:-1]) | (ids[1:] != ids[:-1]))
            who, ids, many, near = (x[once] for x in (who, ids, many, near))
            order = np.lexsort((ids, -near, who))
            who, ids, many, near = (x[order] for x in (who, ids, many, near))
            start = np.flatnonzero(np.append(True, who[1:] != who[:-1]))
            best = np.arange(len(who)) - np.repeat(start, np.diff(np.append(start, len(who)))) < keep
            return pa.RecordBatch.from_arrays([pa.array(x[best]) for x in (who, ids, many)], ["query", "id", "many"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch if rest is None else pa.concat_batches([rest, batch])
            query = rows.column(0).to_numpy()
            last = int(np.searchsorted(query, query[-1]))
            if last:
                yield merged(rows.slice(0, last))
            rest = rows.slice(last)
        if rest is not None:
            yield merged(rest)

    return merge


def _best(cells: DataFrame, keep: int, dtype: str) -> DataFrame:
    """(query, id, many): the ``keep`` best of all that a query is compared with, as a table."""
    found = cells.repartition("cell").sortWithinPartitions("cell", "query", "id").mapInArrow(_search(keep, dtype), "query long, ids array<long>, many array<int>, near array<double>")
    return materialize(found.repartition("query").sortWithinPartitions("query").mapInArrow(_merge(keep), "query long, id long, many int"))


def _true_neighbours(entries: DataFrame, sample: list, k: int) -> list:
    """(number of the query, range, vec) of the k nearest entries of each of a bounded sample of queries (id, vec), by comparing these with all entries."""
    own, asked = np.array([r.id for r in sample]), np.array([r.vec for r in sample], np.float64)

    def run(batches):
        rows, near = [], np.zeros((len(own), 0))
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                part = whole.slice(at, 4096)
                score = asked @ _matrix(part.column(2)).T
                score[own[:, None] == part.column(0).to_numpy()] = -np.inf
                # The best so far and this slice's: their entries are kept, the others go.
                both = np.hstack([near, score])
                best = np.argpartition(-both, k - 1, axis=1)[:, :k] if both.shape[1] > k else np.tile(np.arange(both.shape[1]), (len(own), 1))
                kept = np.unique(best)
                held = sum(r.num_rows for r in rows)
                table = [*rows, part]
                rows = [pa.Table.from_batches(table).take(pa.array(kept)).combine_chunks().to_batches()[0]]
                only = np.full(both.shape, -np.inf)
                np.put_along_axis(only, best, np.take_along_axis(both, best, 1), 1)
                near = only[:, kept]
                assert held + part.num_rows == both.shape[1]
        for q in range(len(own)):
            pick = np.flatnonzero(near[q] > -np.inf)
            if len(pick):
                found = rows[0].take(pa.array(pick))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pick), q, np.int32)), found.column(0), found.column(1), pa.array(near[q][pick]), found.column(2)], ["number", "id", "range", "near", "vec"])

    vec = entries.schema["vec"].dataType.simpleString()
    found = entries.select("id", "range", "vec").mapInArrow(run, f"number int, id long, range int, near double, vec {vec}")
    best = Window.partitionBy("number").orderBy(F.desc("near"), "id")
    return found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k).select("number", "range", "vec").collect()  # at most SAMPLED * k rows


def _fitted(number: int, n: int, dim: int, norm: float, queries: np.ndarray, who: np.ndarray, found: np.ndarray) -> Hashing:
    """A range's hashing that finds TARGET of the sample's neighbours there: more probes first, then wider buckets."""
    k, probes, near = hash_count(n), probe_count(n), NEAR
    if len(who):
        at = found / max(norm, 1e-300)
        unit = queries[who] / np.linalg.norm(queries[who], axis=1, keepdims=True)
        near = float(np.clip(np.sqrt(np.maximum(0, 2 - 2 * (unit * at).sum(axis=1))).mean(), 0.05, 2))
    while True:
        hashing = Hashing(number, n, dim, norm, k, probes, near)
        if k == 1 or not len(who) or hashing.recall(queries, who, found) >= TARGET:
            return hashing
        if probes < probe_count(n) << DOUBLINGS:
            probes *= 2
        else:
            k -= 1


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of which ``is_query`` (over vec_id) holds, the ``k`` nearest found."""
    rows = materialize(valid_vectors(vectors, vec_id, embedding))
    # Equal vectors are one entry; Spark keeps k + 1 of its ids before it shuffles.
    least = Window.partitionBy("vec").orderBy("vec_id")
    entries = rows.withColumn("n", F.row_number().over(least)).where(F.col("n") <= k + 1).groupBy("vec").agg(F.min("vec_id").alias("id"), F.array_sort(F.collect_list("vec_id")).alias("ids"))
    length = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    entries = materialize(entries.withColumn("many", F.size("ids")).withColumn("norm", length))
    largest = entries.agg(F.max("norm")).first()[0] or 1.0
    step = F.when(F.col("norm") > 0, F.least(F.lit(RANGES - 1), F.floor(2 * F.log2(F.lit(largest) / F.col("norm"))))).otherwise(RANGES - 1).cast("int")
    entries = entries.withColumn("range", step)
    sizes = entries.groupBy("range").agg(F.count("*").alias("n"), F.max("norm").alias("norm"), F.max(F.size("vec")).alias("dim")).collect()  # one row for each range
    wanted = rows.where(is_query).select(F.col("vec_id").alias("query_id"), "vec")
    asked = materialize(wanted.join(entries.select("id", "vec"), "vec").select("query_id", "id"))
    queries = entries.join(asked.select("id").distinct(), "id", "left_semi")
    keep = k + 1 + SLACK
    sample = queries.orderBy(F.xxhash64("id"), "id").limit(SAMPLED).select("id", "vec").collect()
    true = _true_neighbours(entries, sample, k) if sample else []
    asked_of = np.array([r.vec for r in sample], np.float64)
    hashings = {}
    for r in sorted(sizes):
        mine = [t for t in true if t.range == r.range]
        hashings[r.range] = _fitted(r.range, r.n, r.dim, r.norm, asked_of, np.array([t.number for t in mine], int), np.array([t.vec for t in mine], np.float64))

    def cut_of(left: DataFrame, right: DataFrame) -> DataFrame:
        count = lambda df, name: df.groupBy("cell").agg(F.ceil(F.count("*") / CELL_ROWS).alias(name)).where(F.col(name) > 1)
        return materialize(count(left, "parts").join(count(right, "query_parts"), "cell", "full"))

    def searched(left: DataFrame, right: DataFrame, cut: DataFrame) -> DataFrame:
        return _best(_cells(left, cut, "parts", "query_parts", False).union(_cells(right, cut, "query_parts", "parts", True)), keep, _dtype(entries))

    cut = cut_of(_rows(entries, hashings, False, False), _rows(queries, hashings, True, False))
    best = searched(_rows(entries, hashings, False, True), _rows(queries, hashings, True, True), cut)

    # Queries that found too few neighbours meet all entries.
    others = rows.count() - 1
    enough = best.groupBy(F.col("query").alias("id")).agg(F.sum("many").alias("found")).where(F.col("found") > min(k, others))
    few = materialize(queries.join(enough, "id", "left_anti"))
    if not few.isEmpty():
        every, these = _scan_rows(entries, False), _scan_rows(few, True)
        more = searched(every, these, cut_of(every.select("cell"), these.select("cell")))
        best = best.join(few.select(F.col("id").alias("query")), "query", "left_anti").union(more)

    # The exact measure, on the original vectors, one product after the other.
    a, b = entries.select(F.col("id").alias("query"), F.col("vec").alias("left")), entries.select("id", F.col("vec").alias("right"), "ids")
    product = F.aggregate(F.zip_with("left", "right", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    scored = best.select("query", "id").join(a, "query").join(b, "id").select("query", F.explode("ids").alias("vec_id"), product.alias("score"))
    ordered = [F.desc("score"), F.asc("vec_id")]
    top = scored.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(*ordered))).where(F.col("n") <= k + 1).drop("n")
    each = asked.join(top, asked["id"] == top["query"]).where("query_id <> vec_id")
    ranked = each.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*ordered))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op3_ann(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
