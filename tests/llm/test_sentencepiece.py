import hashlib
import random
import time

import numpy as np
import pytest
import sentencepiece

from quadrille.llm.sentencepiece_bpe import decode_ids, encode_texts, op2_sentencepiece, piece_table

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def texts():
    r = random.Random(4)
    letters = "abcdefghinorst  ▁éöß\n\t01.,ABCaaaa中文🙂\u0301\x00"
    out = ["", " ", "  ", "a  b   c", " " * 100 + "x", "x" + " " * 37, "a" * 1000, "ha" * 700, "▁▁ ▁a", "\n\n", "🙂" * 20, "<s></s><unk><0x41>"]
    out += ["".join(r.choice(letters) for _ in range(r.randint(1, 60))) for _ in range(3000)]
    out += ["".join(r.choice("thein") for _ in range(2000)), "long text " * 20_000, " " * 50_000]
    return out


def test_ids_and_text_are_the_library_s(library):
    table, every = piece_table(), texts()
    for at in range(0, len(every), 500):
        part = every[at : at + 500]
        got = table.encode(part)
        assert [x.tolist() for x in got] == library.encode(part, num_threads=1)
        assert [table.decode(x) for x in got] == [library.decode(x.tolist()) for x in got]


def test_long_words_are_the_library_s(library, monkeypatch):
    """The way by waiting ranks, for words of any length."""
    import quadrille.llm.sentencepiece_bpe as module

    monkeypatch.setattr(module, "LONG", 1)
    r = random.Random(6)
    table = module.PieceTable(public_tokenizers.path("piece_bpe_32k.model"))
    every = ["".join(r.choice(letters) for _ in range(r.randint(2, 80))) for letters in ("ab", "thein", "aaab", "0123456789abcdef", "thequickbrownfoxjumpsoverthelazydogABCéß中") for _ in range(600)]
    every += ["a" * 5000, "ha" * 3000, "the" * 2000, "er" * 1001 + "s", "tion" * 900, "".join(r.choice("etaoinshrdlu") for _ in range(20_000))]
    assert [x.tolist() for x in table.encode(every)] == library.encode(every, num_threads=1)


def test_a_long_unspaced_text_takes_no_long(library):
    r = random.Random(7)
    text = "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/") for _ in range(1_000_000))
    table = piece_table()
    began = time.time()
    ids = table.encode([text])[0].tolist()
    took = time.time() - began
    assert ids == library.encode(text)
    assert took < 40
    assert text not in table.words


def test_any_ids_decode_alike(library):
    r = random.Random(5)
    for _ in range(3000):
        ids = [r.randrange(32000) if r.random() < 0.7 else r.randrange(3, 259) for _ in range(r.randint(0, 10))]
        assert piece_table().decode(np.array(ids, dtype=np.int64)) == library.decode(ids)


def test_a_full_store_changes_nothing(library, monkeypatch):
    import quadrille.llm.sentencepiece_bpe as module

    monkeypatch.setattr(module, "CACHED_WORDS", 20)
    table = module.PieceTable(public_tokenizers.path("piece_bpe_32k.model"))
    for _ in range(2):
        for text in ("one two three", "many other words stand here " * 3, "one two " + " ".join(map(str, range(50)))):
            assert table.encode([text])[0].tolist() == library.encode(text)


def test_rows(spark, make_docs, library, tmp_path):
    rows = [(1, None), (2, ""), (3, "Hello wörld"), (3, "Hello wörld"), (None, "x")]
    docs = make_docs(rows)
    got = sorted((str(r.doc_id), list(r.ids)) for r in encode_texts(docs).collect())
    assert got == sorted((str(i), library.encode(t or "")) for i, t in rows)
    assert sorted(r.text for r in decode_ids(encode_texts(docs)).collect()) == sorted(t or "" for _, t in rows)
    assert encode_texts(docs.limit(0)).count() == 0
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    row = op2_sentencepiece(spark, str(tmp_path)).where("doc_id = 3").first()
    ids = library.encode("Hello wörld")
    assert row.n_tokens == len(ids) and row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and row.decoded_sha256 == hashlib.sha256("Hello wörld".encode()).hexdigest()
