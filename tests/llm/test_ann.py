import itertools

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quadrille.llm import ann
from quadrille.llm.ann import Hashing, nearest

SCHEMA = "vec_id long, embedding array<float>, label int, id int, query string"


def rows_of(x, first=0):
    return [(first + i, [float(v) for v in row], 1, 2, "q") for i, row in enumerate(x)]


def brute(rows, k=20):
    fine = [(i, np.array(v, np.float32).astype(float)) for i, v, *_ in rows if v and all(a is not None and np.isfinite(a) for a in v) and any(v)]
    ids, x = np.array([i for i, _ in fine]), np.stack([v for _, v in fine])
    out = {}
    for i, v in fine:
        if i % 20 == 0:
            s = x @ v
            order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
            out[i] = [(int(ids[j]), s[j]) for j in order]
    return out


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((3000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = rows_of(x * rng.uniform(0.8, 1.0, (3000, 1)))
    got = nearest(spark.createDataFrame(rows, SCHEMA).repartition(4), F.col("vec_id") % 20 == 0).collect()
    want = brute(rows)
    hits = sum(len({r.vec_id for r in got if r.query_id == q} & {i for i, _ in w}) for q, w in want.items()) / (20 * len(want))
    assert hits >= 0.9
    vector = {i: np.array(v, np.float32).astype(float) for i, v, *_ in rows}
    for q in want:
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, 21))
        assert all(abs(r.score - vector[q] @ vector[r.vec_id]) < 1e-12 for r in mine)
        assert [(-r.score, r.vec_id) for r in mine] == sorted((-r.score, r.vec_id) for r in mine)


@pytest.mark.parametrize("cell", [4096, 8])
def test_few_copies_and_odd_vectors(spark, monkeypatch, cell):
    """So few that every one is found: ties, copies, invalid vectors, own id."""
    monkeypatch.setattr(ann, "CELL_ROWS", cell)
    rng = np.random.default_rng(1)
    rows = rows_of(rng.standard_normal((12, 4)).round(1)) + [(20 + i, [1.0, 0.0, 0.0, 0.0], 1, 2, "q") for i in range(45)]
    rows += [(80, None, 1, 2, "q"), (100, [0.0] * 4, 1, 2, "q"), (120, [1.0, None, 0.0, 0.0], 1, 2, "q"), (140, [float("nan"), 0.0, 0.0, 1.0], 1, 2, "q"), (160, [float("inf"), 0.0, 0.0, 1.0], 1, 2, "q"), (180, [1.0, 2.0], 1, 2, "q")]
    got = nearest(spark.createDataFrame(rows, SCHEMA).repartition(3), F.col("vec_id") % 20 == 0).collect()
    want = brute([r for r in rows if r[0] != 180])
    assert {r.query_id for r in got} == set(want)
    for q, w in want.items():
        assert [(r.vec_id, pytest.approx(r.score)) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == w


def test_empty(spark):
    assert nearest(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 20 == 0).count() == 0


def test_null_and_repeated_ids(spark):
    """Rows without an id take no part; a repeated id is one row, and each query has distinct neighbours."""
    rng = np.random.default_rng(3)
    rows = rows_of(rng.standard_normal((60, 8)).round(2))
    more = [(None, [1.0] * 8, 1, 2, "q"), rows[20], rows[20], rows[37], (0, [99.0] * 8, 1, 2, "q")]
    got = nearest(spark.createDataFrame(rows + more, SCHEMA).repartition(3), F.col("vec_id") % 20 == 0).collect()
    want = brute(rows) if min(rows[0][1], [99.0] * 8) == rows[0][1] else None
    for q, w in want.items():
        assert [(r.vec_id, pytest.approx(r.score)) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == w


@pytest.mark.parametrize("norms", ["one large", "log-normal"])
def test_recall_with_unequal_norms(spark, norms):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((20_000, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x *= rng.lognormal(0, 0.5, (len(x), 1)) if norms == "log-normal" else 1
    x[7] *= 10
    x = x.astype(np.float32)
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(len(x)), "embedding": pa.array(list(x), pa.list_(pa.float32()))}))
    got = nearest(df, F.col("vec_id") % 200 == 0).collect()
    hits = 0
    for q in range(0, len(x), 200):
        s = x.astype(float) @ x[q].astype(float)
        s[q] = -np.inf
        mine = {r.vec_id for r in got if r.query_id == q}
        assert len(mine) == 20
        hits += len(mine & set(np.argsort(-s)[:20].tolist()))
    assert hits / (20 * len(x) / 200) >= 0.9


def test_probes_come_in_order_of_estimated_success():
    h = Hashing(0, 40, 8, 1.0)
    places = np.random.default_rng(2).standard_normal((5, h.k)) * 3
    got, groups = h.visited(places)
    low, rest = np.floor(places), places - np.floor(places)
    spread = ann.NEAR / ann.WIDTH

    def chance(row, steps):
        return sum(np.log(ann._below((d + 1 - rest[row, j]) / spread) - ann._below((d - rest[row, j]) / spread)) for j, d in enumerate(steps))

    for row in range(5):
        every = sorted(itertools.product(range(-2, 3), repeat=h.k), key=lambda steps: -chance(row, steps))[: h.probes]
        assert got[row].tolist() == [int(h.bucket(low[row] + np.array(steps))) for steps in every]
        assert groups[row].tolist() == [int(h.bucket(low[row] + np.array(steps), h.g)) for steps in every]


@pytest.mark.parametrize("kind", ["many dimensions", "near copies"])
def test_recall_on_hard_rows(spark, kind):
    """Many dimensions need more probes than few; copies that differ by a thousandth need exact comparisons."""
    rng = np.random.default_rng(6)
    n = 6000
    x = rng.standard_normal((n, 192)) if kind == "many dimensions" else rng.standard_normal((6, 48))[rng.integers(6, size=n)] + 1e-3 * rng.standard_normal((n, 48))
    x = x.astype(np.float32)
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(n), "embedding": pa.array(list(x), pa.list_(pa.float32()))}))
    got = nearest(df, F.col("vec_id") % 60 == 0).collect()
    hits = 0
    for q in range(0, n, 60):
        s = x.astype(float) @ x[q].astype(float)
        s[q] = -np.inf
        hits += len({r.vec_id for r in got if r.query_id == q} & set(np.argsort(-s)[:20].tolist()))
    assert hits / (20 * n / 60) >= 0.9
