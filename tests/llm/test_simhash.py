import random
import re

import xxhash
from pyspark.sql import functions as F

from quadrille.llm import simhash
from quadrille.llm.simhash import components, fingerprint, links, near_duplicates, simhash_dedup


def brute_print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = re.findall("[^\x20\x09-\x0d]+", low)
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints():
    r = random.Random(1)
    for _ in range(200):
        text = "".join(r.choice("ab AB\n\tÉé ") for _ in range(r.randint(0, 60)))
        assert fingerprint(text.encode()) == brute_print(text)
    long = "x y z w " * 30_000
    assert fingerprint(long.encode()) == brute_print(long)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def near(base, n, r):
    """Fingerprints around ``base``: chains of flips."""
    out = {base}
    while len(out) < n:
        x = r.choice(sorted(out))
        for _ in range(r.randint(1, 3)):
            x ^= 1 << r.randrange(64)
        out.add(x)
    return out


def test_links_are_all_and_only_those_within_two_bits(spark, monkeypatch):
    r = random.Random(2)
    prints = set().union(*[near(r.getrandbits(64), n, r) for n in (300, 50, 5)], {0, 1, (1 << 64) - 1}, {r.getrandbits(64) for _ in range(200)})
    want = {(min(a, b), max(a, b)) for a in map(signed, prints) for b in map(signed, prints) if a != b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}
    df = spark.createDataFrame([(signed(x),) for x in prints], "fp long")
    for crowded in (128, 4):  # with and without the finer bands
        monkeypatch.setattr(simhash, "CROWDED", crowded)
        assert {tuple(x) for x in links(df).collect()} == want


def test_components(spark):
    r = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 130)] + [(r.randrange(200, 260), r.randrange(200, 260)) for _ in range(50)] + [(7, 7), (-5, 3)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {n: c for n, c in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got.get(x, x) == find(x) for x in parent)
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_rows(make_docs):
    base = " ".join(f"w{i * i % 1000}" for i in range(2000))
    rows = [(9, base), (4, base.replace("w81 ", "w82 ", 1)), (7, "other text of its own"), (1, None), (2, ""), (3, " \n\t"), (6, "One TWO"), (5, "one two"), (5, "one two"), (None, "lone row")]
    docs = make_docs(rows)
    got = {(r.doc_id, r.component_id) for r in near_duplicates(docs).collect()}
    assert got == {(9, 4), (4, 4), (7, 7), (1, 1), (2, 1), (3, 1), (6, 5), (5, 5), (None, None)}
    assert near_duplicates(docs).count() == len(rows)
    assert near_duplicates(docs.limit(0)).count() == 0
    kept = simhash_dedup(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.select("doc_id").collect()) == ["1", "4", "5", "5", "7", "None"]
    assert kept.select(F.sum("row")).first()[0] == 18
