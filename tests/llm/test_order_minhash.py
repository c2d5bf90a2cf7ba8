import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quadrille.llm import order_minhash as om


def brute_signature(text):
    """All 128 rounds of all elements, sorted in each channel."""
    mask = (1 << 64) - 1
    number = lambda x: int(om._mix(np.array([x & mask], np.uint64))[0])
    seen, elements = {}, []
    for at, h in enumerate(om.kmer_hashes(text).tolist()):
        seen[h] = seen.get(h, -1) + 1
        elements.append((h, seen[h], at, number(h + seen[h] * int(om._FACTORS[1]))))
    elements.sort()
    out = []
    for c in range(om.CHANNELS):
        found = []
        for i, (_, _, at, e) in enumerate(elements):
            r = next(r for r in range(om.CHANNELS) if (e + r * (e >> 7 | 1)) % om.CHANNELS == c)
            u = number(e ^ (r * int(om._FACTORS[1]) & mask)) if r else e
            found.append((r, u >> 38, i, at, e))
        t = 0
        for _, e in sorted((at, e) for *_, at, e in sorted(found)[: om.TUPLE]):
            t = number(t * int(om._FACTORS[2]) + e)
        out.append(t >> 48)
    return out


@pytest.mark.parametrize("text", ["", "a", "abcdefg", "abcdefgh", "abcdefghi", "ab" * 30, "ünï中🙂 code points", "the quick brown fox jumps over the lazy dog. " * 3])
def test_signature_equals_brute_force(text):
    assert om.signature(text).tolist() == brute_signature(text)


@settings(max_examples=15, deadline=None)
@given(st.text(st.sampled_from("abc é中"), max_size=40))
def test_signature_of_random_texts(text):
    assert om.signature(text).tolist() == brute_signature(text)


def test_fewer_offers_give_the_same(monkeypatch):
    """Rounds and filters only save work; places beyond the packed ones sort the same."""
    rng = random.Random(1)
    texts = ["".join(rng.choices("abcdef gh", k=n)) for n in (9, 100, 1500, 1560, 20_000)]
    want = [om.signature(t).tolist() for t in texts]
    for offered in (3, 40):
        monkeypatch.setattr(om, "OFFERED", offered)
        assert [om.signature(t).tolist() for t in texts] == want
    h = om.kmer_hashes("abababababcabab" * 20)
    packed = om.numbered(h)
    at = np.argsort(h, kind="stable")
    assert packed[1].tolist() == at.tolist()


def test_likeness_follows_edits_and_order():
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(1200)]
    text = " ".join(words)
    sig = om.signature(text)
    like = lambda other: float((om.signature(other) == sig).mean())
    few = [" ".join(w if i % 100 else "zzzzzz" for i, w in enumerate(words)), " ".join(w if i % 10 else "zzzzzz" for i, w in enumerate(words))]
    assert 1.0 > like(few[0]) > like(few[1]) > 0.1
    # The same k-mers in another order of blocks: far in edit distance.
    blocks = [words[i : i + 100] for i in range(0, 1200, 100)]
    assert like(" ".join(w for b in reversed(blocks) for w in b)) < 0.3 < 0.6 < like(few[0])


def brute_table(rows):
    """(doc_id, text) rows with distinct ids."""
    rows = sorted(((i, t or "") for i, t in rows), reverse=True)
    out = {}
    for j, (i, t) in enumerate(rows):
        after = rows[(j + 1) % len(rows)][1]
        half = len(t) // 2
        new = t[: len(t) - half] + after[:half]
        s = [om.signature(x) for x in (t, new, after)]
        out[i] = (len(t), hashlib.sha256(new.encode()).hexdigest(), om.as_hex(s[0]), om.as_hex(s[1]), float((s[0] == s[1]).mean()), float((s[0] == s[2]).mean()))
    return out


def test_table_equals_brute_force(make_docs):
    rng = random.Random(3)
    rows = [(i * i - 50, "".join(rng.choices("abc déf\n中", k=rng.choice([0, 1, 5, 40, 300])))) for i in range(120)] + [(10**12, None), (-(10**12), "last " * 50)]
    got = {r.doc_id: tuple(r)[1:] for r in om.with_edited(make_docs(rows, 5)).collect()}
    assert got == brute_table(rows)
    one = om.with_edited(make_docs([(7, "only one document")])).collect()
    assert [tuple(r)[1:] for r in one] == [brute_table([(7, "only one document")])[7]]
    assert om.with_edited(make_docs([]).limit(0)).count() == 0


def test_null_and_repeated_ids_and_ties(make_docs):
    rows = [(None, f"text {i % 7}") for i in range(60)] + [(5, f"same id {i % 9}") for i in range(200)] + [(i, f"own {i}") for i in range(20, 60)]
    got = om.with_edited(make_docs(rows, 4)).collect()
    assert sorted((r.doc_id, r.n_chars) for r in got if r.doc_id is not None) == sorted((i, len(t)) for i, t in rows if i is not None)
    assert sum(r.doc_id is None for r in got) == 60
    prints = {}
    for r in got:
        prints.setdefault(r.fingerprint, set()).add(r.n_chars)
    assert len(prints) == len({t for _, t in rows})
    order = {r.doc_id: r for r in got}
    assert order[30].edited_sha256 == hashlib.sha256(b"own" + b"own").hexdigest()
    # Last of the ids comes the first without one, and the other way round: every row has exactly one next row.
    assert len(got) == len(rows)


def test_groups_are_split(make_docs):
    """An id that a third of the rows have spans several groups, in order."""
    rows = [(5, f"same id {i}") for i in range(300)] + [(i, f"own {i}") for i in range(10, 600)]
    dealt = om.in_order(make_docs(rows, 4).select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    of_five = dealt.where("doc_id = 5 AND NOT halo").groupBy("grp").count().collect()
    assert len(of_five) >= 3 and dealt.where("NOT halo").count() == len(rows)
    assert dealt.where("halo").count() == dealt.select("grp").distinct().count()


def test_fingerprints_and_likeness_columns(make_docs):
    docs = make_docs([(1, "one text of some length, with words"), (2, "one text of some length, with words"), (3, None), (4, "one text of some length, with birds")])
    f = om.fingerprints(docs)
    a, b = f.select("doc_id", "fingerprint"), f.select(F.col("doc_id").alias("other"), F.col("fingerprint").alias("g"))
    got = {(r.doc_id, r.other): r.x for r in a.join(b, F.col("doc_id") < F.col("other")).select("doc_id", "other", om.likeness("fingerprint", "g").alias("x")).collect()}
    assert got[1, 2] == 1.0 and got[1, 3] == 0.0 and 0.2 < got[1, 4] < 1.0


def test_long_text(make_docs):
    rng = random.Random(4)
    long = "".join(rng.choices("abcdefgh \n", k=2_000_000))
    rows = [(1, long), (2, long[:1_000_000] + "x" + long[1_000_000:]), (3, "short")]
    got = {r.doc_id: r for r in om.with_edited(make_docs(rows)).collect()}
    assert got[2].near_next > 0.9 and got[1].n_chars == 2_000_000 and got[3].near_next == 0.0
