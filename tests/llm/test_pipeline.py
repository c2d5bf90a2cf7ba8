import re

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from quadrille.llm.packing import pack_documents
from quadrille.llm.quality import quality_table
from quadrille.llm.secrets import scan
from tests_llm_brute import brute_lines, components_of

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def folder(make_docs, tmp_path_factory):
    """Clean documents, junk, copies, near copies, shared lines and secrets."""
    rng = np.random.default_rng(3)
    clean = [(i, "\n".join(" ".join(f"w{rng.integers(5000)}" for _ in range(12)) for _ in range(6))) for i in range(150)]
    shared = [(200 + i, f"{clean[i][1][::-1]}\nA line that very many documents share, licence and all.") for i in range(15)]
    copies = [(300 + i, clean[3][1]) for i in range(3)] + [(310 + i, clean[5][1].upper().lower() + "\nlast") for i in range(12)]
    junk = [(400 + i, " ".join(f"w{rng.integers(5000)}###" for _ in range(50))) for i in range(5)]
    secret = [(500, clean[20][1][::-1] + "\npassword=abcdef123456 end")]
    where = tmp_path_factory.mktemp("corpus")
    make_docs([*clean, *shared, *copies, *junk, *secret, (600, None), (601, "")]).write.parquet(f"{where}/documents.parquet")
    return str(where)


def test_pipeline_agrees_with_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {r.doc_id for r in quality_table(docs).where("kept").collect()}
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id in kept}
    assert set(range(150)) <= kept and not kept & {400, 401, 402, 403, 404, 600, 601}
    texts = brute_lines(texts)
    root = components_of(texts)
    texts = {i: t for i, t in texts.items() if root[i] == i}
    for i, t in texts.items():
        for s, _, e in reversed(scan(t)):
            t = t[:s] + "[secret]" + t[e:]
        texts[i] = t
    assert "[secret]" in texts[500] and 300 not in texts and 3 in texts
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sorted((i, len(library.encode(t, add_special_tokens=False).ids) + 1) for i, t in texts.items())
    out = corpus_pipeline.run(spark, folder).collect()
    total = {}
    for r in out:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
    assert sorted(total.items()) == want


def test_stages_keep_the_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns
    assert re.match("doc_id", pack_documents(docs).columns[0])


def test_empty_documents_table(spark, make_docs, tmp_path):
    make_docs([(1, "x")]).limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
