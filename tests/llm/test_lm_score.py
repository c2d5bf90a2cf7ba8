import math
import re
import zlib
from collections import Counter

import numpy as np

from quadrille.llm import lm_score
from quadrille.llm.lm_score import Layout, Model, histories, score_texts


def brute(rows):
    split = [(i, re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) + [None]) for i, t in rows]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    c = Counter(w for i, words in split if not held(i) for w in words)
    n, v = sum(c.values()), len(c)
    return sorted((str(i), held(i), len(words), sum(c[w] > 0 for w in words), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words), 6)) for i, words in split)


def test_base(make_docs, monkeypatch):
    monkeypatch.setattr(lm_score, "HEAD_WORDS", 5)  # most words are rare
    rows = [(i, f"The cat {i} sat on the MAT " + "zyx " * (i % 3)) for i in range(40)] + [(50, None), (51, ""), (52, "Éa \x1c b"), (52, "Éa \x1c b"), (None, "the cat")]
    docs = make_docs(rows)
    got = score_texts(docs).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == brute(rows)
    assert all(r.score < 0 for r in got)
    assert score_texts(docs.limit(0)).count() == 0


def test_model_is_normalised_and_learns():
    """Probabilities of all symbols sum to one, and come near the truth that texts were drawn from."""
    rng = np.random.default_rng(0)
    layout = Layout(40)
    n = layout.symbols
    true = rng.dirichlet(np.full(41, 0.1), 41)
    walk = lambda steps: np.array([w := 0, *[w := rng.choice(41, p=true[w]) for _ in range(steps)]][1:])
    seen, held = walk(60_000), walk(4_000)
    model = Model(layout, np.bincount(seen, minlength=n).astype(float))
    train_on = model.trainer(rng)
    history, target = histories(seen)
    for _ in range(4):
        for at in range(0, len(target), 256):
            train_on(history[at : at + 256], target[at : at + 256])
    score = model.scorer()
    some, _ = histories(held[:50])
    every = np.array([score(some, np.full(len(some), s)) for s in range(n)])
    assert np.allclose((10.0**every).sum(axis=0), 1, atol=1e-4)
    history, target = histories(held)
    got = score(history, target).sum()
    unigram = np.log10((np.bincount(seen, minlength=n)[target] + 0.5) / (len(seen) + 0.5 * n)).sum()
    best = np.log10(true[np.append(0, held[:-1]), held]).sum()
    assert got > unigram + 0.6 * (best - unigram)


def test_scores_do_not_depend_on_the_batch(make_docs, monkeypatch):
    rows = [(i, " ".join(f"w{(i * j) % 17}" for j in range(60))) for i in range(60)] + [(99, "w1 " * 30_000)]
    one = {r.doc_id: r.score for r in score_texts(make_docs(rows, 1)).collect()}
    monkeypatch.setattr(lm_score, "SCORED_TOKENS", 50)
    other = {r.doc_id: r.score for r in score_texts(make_docs(rows, 1)).collect()}
    assert all(math.isclose(one[i], other[i], rel_tol=1e-4) for i in one)


def test_model_beats_counts_on_held_out_texts(make_docs):
    rng = np.random.default_rng(1)
    nxt = rng.integers(0, 50, (50, 2))
    rows = []
    for i in range(300):
        w, words = int(rng.integers(50)), []
        for _ in range(80):
            words.append(f"w{w}")
            w = int(nxt[w, rng.integers(2)])
        rows.append((i, " ".join(words)))
    held = score_texts(make_docs(rows)).where("held_out").collect()
    assert sum(r.score for r in held) > 0.7 * sum(r.base_score for r in held)
