import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quadrille.llm import spelling as sp

LETTERS = re.compile("[A-Za-zÀ-ÿ]+")
lower = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def brute_counts(docs):
    out = Counter()
    for i, text in docs:
        for run in LETTERS.findall(text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 5:
                out[run] += 1
    return out


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(counts):
    words = {w: n for w, n in counts.items() if n >= 3}
    rows, forms = {}, {}
    for w, n in words.items():
        found = [x for x in words if near(w, x)]
        best = min(found, key=lambda x: (-words[x], x), default=None)
        forms[w] = best if best is not None and words[best] >= 2 * n else None
        rows[w] = [n, len(found), forms[w], words.get(forms[w])]
    for w in rows:
        root = w
        while forms[root] is not None:
            root = forms[root]
        rows[w].append(root)
    return {w: tuple(r) for w, r in rows.items()}


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("aBÀé× \n1Ā中¿\xa0\x85"), max_size=40))
def test_runs(text):
    assert [w.decode("latin-1") for w in sp.runs(text.encode())] == [w.translate(lower) for w in LETTERS.findall(text)]


def test_counts_equal_brute_force(make_docs):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdeé", k=rng.randint(3, 9))) for _ in range(300)]
    docs = [(i, " ".join(rng.choices(words, k=80)).title()) for i in range(150)] + [(None, "nothing stands before this"), (7, None), (8, ""), (9, "same same words words words"), (9, "same same words words words")]
    for kept in (sp.KEPT_WORDS, 50):
        sp_kept, sp.KEPT_WORDS = sp.KEPT_WORDS, kept
        try:
            got = {r.word: r.n for r in sp.word_counts(make_docs(docs)).collect()}
        finally:
            sp.KEPT_WORDS = sp_kept
        assert got == brute_counts(docs)
    assert sp.word_counts(make_docs([]).limit(0)).count() == 0


def variants(spark, counts):
    df = spark.createDataFrame([(w, n) for w, n in counts.items() if n >= 3], "word string, n long")
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in sp.spelling_variants(df).collect()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_variants_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    words = {"".join(rng.choices("abé", k=rng.randint(5, 8))) for _ in range(400)}
    counts = {w: int(3 * 2 ** rng.uniform(0, 8)) for w in words}
    assert variants(spark, counts) == brute_variants(counts)


def test_ties_chains_and_long_words(spark):
    counts = {"aaaaaa": 3, "aaaaab": 6, "aaaabb": 12, "aaabbb": 24, "aabbbb": 24, "aaaaaac": 6, "zzzzzz": 3, "zzzzz": 5, "yyyyy": 3, "yyyyyx": 6, "yyyyx": 6}
    long = "x" * 20_000
    counts |= {long: 3, long + "x": 4, long[:-1] + "y": 9, long[:9] + "é" + long[10:]: 6}
    got = variants(spark, counts)
    assert got == brute_variants(counts)
    assert got["aaaaaa"][2] == "aaaaaac" or got["aaaaaa"][2] == "aaaaab"
    assert got["aaaaab"][4] == "aaabbb"


def test_no_words(spark):
    assert sp.spelling_variants(spark.createDataFrame([], "word string, n long")).count() == 0
    assert variants(spark, {"alone": 3}) == {"alone": (3, 0, None, None, "alone")}


def test_group_keys_meet_exactly_where_words_are_near():
    words = [b"abcde", b"abcdd", b"abcd" + b"ee", b"abcdde", b"bacde", b"aaaaa", b"aaaaaa"]
    number, kind, k1, k2 = sp.group_keys(words)
    groups = {}
    for i, k, *key in zip(number.tolist(), kind.tolist(), k1.tolist(), k2.tolist()):
        groups.setdefault(tuple(key), []).append((k, i))
    pairs = set()
    for g in groups.values():
        kinds = [k for k, _ in g]
        assert kinds.count(sp.OWN) <= 1 and (sp.WILD not in kinds or set(kinds) == {sp.WILD})
        ends = [i for k, i in g if k == sp.OWN]
        pairs |= {(min(i, j), max(i, j)) for _, i in g for _, j in g if i != j and (kinds[0] == sp.WILD or i in ends or j in ends)}
    assert pairs == {(i, j) for i in range(len(words)) for j in range(i + 1, len(words)) if near(words[i].decode(), words[j].decode())}
    assert len(number) == sum(1 + len(w) + len({w[:i] + w[i + 1 :] for i in range(len(w))}) for w in words)
