import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrille.llm import near_copies
from quadrille.llm.near_copies import near_copy_dedup
from quadrille.llm.near_copies import near_copies as found


def shingles(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """The smallest id reachable by links of similarity 0.8 or more."""
    sets = [(i, shingles(t or "")) for i, t in rows if i is not None]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in sets:
        for j, b in sets:
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {(i, find(i)) for i in root}


def corpus():
    r = random.Random(5)
    rows = []
    for base in range(12):
        words = [f"w{r.randrange(4000)}" for _ in range(r.choice((30, 80, 200)))]
        rows.append(words)
        for _ in range(r.choice((1, 4, 30))):
            changed = list(r.choice(rows[-3:]))
            for _ in range(r.randrange(4)):
                changed[r.randrange(len(changed))] = f"x{r.randrange(4000)}"
            rows.append(changed + [f"y{r.randrange(9)}"] * r.randrange(3))
    r.shuffle(rows)
    texts = [" ".join(x) for x in rows]
    return list(enumerate([*texts, "", None, " \n", "A b C", "a B c", "a b d", texts[0].upper()])) + [(3, texts[3])]


@pytest.mark.parametrize(("crowded", "sampled"), [(64, 16), (2, 1)])
def test_groups_agree_with_brute_force(make_docs, monkeypatch, crowded, sampled):
    monkeypatch.setattr(near_copies, "CROWDED", crowded)
    monkeypatch.setattr(near_copies, "SAMPLED", sampled)
    rows = corpus()
    docs = make_docs([*rows, (None, "A b C")])
    want = brute(rows)
    assert {(r.doc_id, r.component_id) for r in found(docs).collect()} == want
    kept = near_copy_dedup(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, c in want if i == c} | {None}


def test_stage_drops_near_copies_that_few_bits_do_not_show(spark, make_docs):
    import corpus_pipeline
    from quadrille.llm.simhash import fingerprint

    words = [f"w{i * i % 9973}" for i in range(200)]
    other = [f"changed{i}" if i in (30, 80, 130, 180) else w for i, w in enumerate(words)]
    texts = [" ".join(words), " ".join(other)]
    a, b = map(shingles, texts)
    assert len(a & b) / len(a | b) >= 0.8 and (fingerprint(texts[0].encode()) ^ fingerprint(texts[1].encode())).bit_count() > 2
    out = corpus_pipeline.near_dedup_stage(spark, make_docs(list(enumerate(texts))), "")
    assert [r.doc_id for r in out.collect()] == [0]


def test_empty(make_docs):
    assert near_copy_dedup(make_docs([(1, "x")]).limit(0)).count() == 0


def test_fingerprints_link_first(spark, make_docs, monkeypatch):
    """Close copies are found through the fingerprints' pivot tables, without the exact join."""
    rng = np.random.default_rng(9)
    texts = [" ".join(f"w{rng.integers(5000)}" for _ in range(400)) for _ in range(20)]
    docs = make_docs([(i, t) for i, t in enumerate(texts)] + [(100 + i, t + " end") for i, t in enumerate(texts)])
    monkeypatch.setattr(near_copies, "_met", lambda rows: rows.select(F.col("sid").alias("u"), F.col("sid").alias("v")).limit(0))
    found = {r.doc_id: r.component_id for r in near_copies.near_copies(docs).collect()}
    assert sum(found[100 + i] == i for i in range(20)) >= 15 and all(found[i] == i for i in range(20))


def test_prefixes_are_written_once(make_docs, monkeypatch):
    written = []
    keep = near_copies.materialize
    monkeypatch.setattr(near_copies, "materialize", lambda df: written.append(set(df.columns)) or keep(df))
    assert found(make_docs([(1, "a b c d e f"), (2, "a b c d e f"), (3, "g")])).count() == 3
    assert sum({"n", "keys"} <= columns for columns in written) == 1
