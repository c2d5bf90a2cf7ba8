import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quadrille.llm.packing import WordTokens, pack_documents, pack_residuals, plan_packing, slots

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def test_ids_are_the_library_s(library):
    r = random.Random(5)
    letters = "abcABC  ..,,!?'é\u0308éß\n\t012中ſK\x1c\u00a0İΣ"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(1, 40))) for _ in range(5000)]
    texts += ["".join(r.choice([*letters, "<|endoftext|>", "<|"]) for _ in range(r.randint(1, 40))) for _ in range(2000)]
    texts += ["a <|endoftext|> b", "A<|STARTOFTEXT|>b", "it's. I'm, 'll.", "", "  "]
    got = WordTokens().encode([x.encode() for x in texts])
    for text, ids, want in zip(texts, got, library.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(ids, "<u4").tolist() == want.ids, text


def check_plan(counts, capacity):
    plan = plan_packing(counts, capacity)
    used = np.zeros_like(counts)
    for pattern, many in plan:
        assert many > 0 and sum(n * k for n, k in pattern) <= capacity
        for n, k in pattern:
            used[n] += many * k
    assert (used == counts).all()
    ends = defaultdict(int)
    for length, low, high, *_ in slots(plan):
        assert low == ends[length]
        ends[length] = high
    return sum(many for _, many in plan)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=200))
def test_plans_use_every_piece(lengths):
    check_plan(np.bincount(np.array(lengths, np.int64), minlength=33), 32)


@pytest.mark.parametrize("n", [60, 60_000])
@pytest.mark.parametrize("kind", ["uniform", "narrow", "log-normal", "few lengths"])
def test_plans_are_never_worse_than_best_fit(kind, n):
    rng = np.random.default_rng(0)
    lengths = {
        "uniform": rng.integers(1, 2049, n),
        "narrow": rng.integers(300, 1001, n),
        "log-normal": np.clip(rng.lognormal(6, 1, n).astype(int), 1, 2048),
        "few lengths": rng.choice([2048, 1500, 700, 683, 400, 31], n),
    }[kind]
    counts = np.bincount(lengths, minlength=2049)
    rest = counts.copy()
    rest[2048] = 0
    best_fit = sum(n for _, n in pack_residuals(rest, 2048)) + counts[2048]
    made = check_plan(counts, 2048)
    assert -(-int(lengths.sum()) // 2048) <= made <= best_fit
    if kind == "narrow" and n > 60:
        assert made < best_fit * 0.98


def test_rows(make_docs, library):
    r = random.Random(6)
    rows = [(i, " ".join(r.choice(["alpha", "be", "gamma,", "x."]) for _ in range(r.randint(0, 3000)))) for i in range(60)] + [(100, None), (101, ""), (102, "same"), (102, "same"), (None, "no id"), (103, "word " * 10_000)]
    docs = make_docs(rows)
    out = pack_documents(docs, ids=True).collect()
    want = defaultdict(list)
    for i, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            want[str(i)].append((k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(np.array(ids[k : k + 2048], "<u4").tobytes())))
    got = defaultdict(list)
    sequences = defaultdict(list)
    for x in out:
        got[str(x.doc_id)].append((x.piece, x.start, x.length, x.ids_crc32))
        sequences[x.sequence_id].append((x.offset, x.length))
        assert len(x.ids) == x.length
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert pack_documents(docs.limit(0)).count() == 0
