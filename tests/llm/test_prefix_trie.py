import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrille.llm import prefix_trie as pt
from quadrille.llm.scan import running

SCHEMA = "conv_id long, turn long, role string, text string, pos long, rank long, words string"


def brute(rows):
    """Nodes of rows (conv_id, turn, role, text) without ties in turn, by sequences in a dictionary."""
    own = {}
    for c, turn, role, text in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own.setdefault(c, []).append((role or "", text or ""))
    convs = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        convs[c] = tuple(own.get(c - c % 20, [])[:h] + own[c][h:])
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    children = {n: [] for n in members}
    for n in members:
        if n:
            children[n[:-1]].append(n)
    leaves, saved, out = {}, {}, set()
    for n in sorted(members, key=len, reverse=True):
        words = len(re.findall("[^\x20\x09-\x0d]+", n[-1][1])) if n else 0
        leaves[n] = sum(leaves[x] for x in children[n]) or 1
        saved[n] = (len(members[n]) - 1) * words + sum(saved[x] for x in children[n])
        ends = ",".join(str(c) for c in sorted(members[n]) if len(convs[c]) == len(n))
        out.add((min(members[n]), len(n), min(members[n[:-1]]) if n else None, len(members[n]), len(children[n]), leaves[n], saved[n], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def nodes(spark, rows, partitions=3):
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA).repartition(partitions)
    ranked = pt.materialize(pt.ranked_turns(pt.digests(df)))
    out = pt.trie_nodes(*pt.shared_beginnings(ranked)).collect()
    assert len(out) == len(set(map(tuple, out)))
    return set(map(tuple, out))


def conversations(rng, n, texts, most=6, start=0):
    rows = []
    for c in range(start, start + n):
        rows += [(c, None if t == 0 and rng.random() < 0.2 else t, rng.choice(["user", None]), rng.choice(texts)) for t in range(rng.randint(1, most))]
    return rows


@pytest.mark.parametrize("heavy", [256, 3])
def test_equals_brute_force(spark, heavy, monkeypatch):
    monkeypatch.setattr(pt, "LEAST_HEAVY", heavy)
    rng = random.Random(heavy)
    rows = conversations(rng, 250, ["a", "b c", None, "", "d\te\nf g"])
    rows += [(c, t, "user", f"copy {t}") for c in range(400, 460) for t in range(5)]  # one conversation, many copies
    rows += [(c, t, "user", f"long {t}") for c in range(500, 520) for t in range(c - 480)]  # each a turn longer
    assert nodes(spark, rows) == brute(rows)


def test_a_long_conversation_and_its_copies(spark, monkeypatch):
    monkeypatch.setattr(pt, "LEAST_HEAVY", 2)
    monkeypatch.setattr(pt, "PIECE_IDS", 3)
    rows = [(c, t, "user", f"turn {t}") for c in (40, 60, 80, 100) for t in range(2500)] + [(c, t, "user", "x") for c in range(100, 400) for t in range(1, 3) if c != 100]
    assert nodes(spark, rows, 8) == brute(rows)


def test_missing_families_short_ones_and_empty(spark):
    rows = [(3, 0, "user", "only one"), (25, 1, None, None), (41, 5, "user", "a"), (40, 1, "user", "first"), (61, 1, "a", "b"), (62, 1, "a", "b"), (62, 2, "a", "b")]
    assert nodes(spark, rows) == brute(rows)
    assert nodes(spark, [(None, 1, "user", "x"), *rows]) == brute(rows)
    assert nodes(spark, []) == set()
    lone = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 == 3)
    assert nodes(spark, [(lone, 1, "user", "gone")]) == brute([(lone, 1, "user", "gone")]) == {(lone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())}


def test_ties_are_taken_in_one_order(spark):
    rows = [(1, 1, "user", x) for x in "abcab"] + [(2, None, "user", x) for x in "cabba"]
    assert nodes(spark, rows, 1) == nodes(spark, rows[::-1], 5)


def test_shards_navigate_by_their_bits(spark):
    rng = random.Random(9)
    rows = conversations(rng, 120, ["a", "b", "c"], 5)
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA)
    turns, convs = pt.shared_beginnings(pt.materialize(pt.ranked_turns(pt.digests(df))))
    _, lower, upper = pt.prefix_tries(pt.materialize(pt.prefixes(turns, convs)))
    shards = lower.collect()
    assert upper.count() == 1 and sum(len(s.edges) for s in shards) > 50
    for s in shards:
        n = len(s.edges)
        bits = np.unpackbits(np.frombuffer(s.bits, np.uint8))[: 2 * n + 1].astype(bool)
        assert bits.sum() == n and list(pt.children_of(bits, 0)) == list(range(1, s.n_trees + 1))
        parents = {k: i for i in range(n + 1) for k in pt.children_of(bits, i)}
        assert sorted(parents) == list(range(1, n + 1))
        for k, i in parents.items():
            e = s.edges[k - 1]
            assert e.outer == (i == 0) and (i == 0 or ((e.p1, e.p2) == (s.edges[i - 1].h1, s.edges[i - 1].h2) and e.parent_conv_id == s.edges[i - 1].conv_id))
        for i in range(n + 1):
            own = [s.labels[k - 1] for k in pt.children_of(bits, i)]
            assert own == sorted(own) and len(own) == (s.n_trees if i == 0 else s.edges[i - 1].n_children)


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_running_totals(spark, partitions):
    rng = random.Random(11)
    rows = [(rng.choice([1, 1, 1, 1, 2, 3, 9]), i, rng.randint(-5, 5), rng.getrandbits(63) - 2**62) for i in range(3000)]
    df = spark.createDataFrame(rows, "k long, i long, v long, x long").repartition(5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = {(r.k, r.i): (r.r_v, r.r_x) for r in running(df, "k", [F.col("i")], ["v"], ["x"]).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want, totals = {}, {}
    for k, i, v, x in rows:
        a, b = totals.get(k, (0, 0))
        want[k, i] = totals[k] = (a + v, b ^ x)
    assert got == want
