import hashlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest

from quadrille.llm import line_dedup as line_dedup_module
from quadrille.llm.line_dedup import OP7_SQL, TwoFilters, line_dedup, op7_line_dedup, repeat_filter


def key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})


def brute(rows, least=10):
    n = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")} if k)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if n[key(x)] < least]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


ROWS = [(i, f"own line {i}\nShared LINE\nÉt é{i % 3}") for i in range(12)] + [(20, None), (21, ""), (22, "\n\n"), (23, "shared line \r\nx"), (24, "shared line"), (24, "shared line"), (None, "\tSHARED line\nz"), (25, "a\n" * 50_000)]


def test_rows(make_docs):
    docs = make_docs(ROWS)
    got = sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.text or "") for r in line_dedup(docs, counts=True).collect())
    assert got == sorted((str(i), *x) for i, *x in brute(ROWS))
    assert line_dedup(docs).columns == docs.columns
    assert line_dedup(docs.limit(0)).count() == 0
    assert line_dedup(docs).where("doc_id = 20").first().text is None


@pytest.mark.parametrize("name,value", [("MOST_BITS", 1 << 19), ("HOT_SHARE", 1), ("HOT_SHARE", 10**9)])
def test_full_filters_and_hot_lines_change_nothing(make_docs, monkeypatch, name, value):
    monkeypatch.setattr(line_dedup_module, name, value)
    monkeypatch.setattr(line_dedup_module, "LEAST_BITS", 1 << 19)
    rows = [(i, "\n".join(f"{i % 7} {j % 90}" for j in range(i, i + 60)) + f"\nonly {i}") for i in range(300)]
    got = sorted((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in line_dedup(make_docs(rows), counts=True).collect())
    assert got == sorted(brute(rows))


def test_first_occurrence_stays(make_docs):
    out = {r.doc_id: r.text for r in line_dedup(make_docs(ROWS), keep="first").collect()}
    assert out[0] == ROWS[0][1].replace("Ét é0", "Ét é0") and "Shared LINE" not in out[1] and out[24] == ""


def test_filter_has_every_repeat(make_docs):
    docs = make_docs(ROWS)
    bitmap = repeat_filter(docs)
    from quadrille.llm.line_dedup import digest, positions

    a, b = positions([digest(b"shared line")], len(bitmap) * 8)
    assert (TwoFilters.has(bitmap, a) & TwoFilters.has(bitmap, b)).all()
    assert np.unpackbits(bitmap).sum() < 200


def test_query_agrees_with_its_sql(spark, make_docs, tmp_path):
    pd.DataFrame({"doc_id": [i for i, _ in ROWS if i is not None], "text": [t for i, t in ROWS if i is not None]}).to_parquet(tmp_path / "documents.parquet")
    got = op7_line_dedup(spark, str(tmp_path)).collect()
    db = duckdb.connect()
    db.sql(f"create view documents as select * from '{tmp_path}/documents.parquet'")
    want = db.sql(OP7_SQL).fetchall()
    assert sorted(tuple(r) for r in got) == sorted(want)
    assert {r.kept_sha256 for r in got if r.doc_id == 21} == {hashlib.sha256(b"").hexdigest()}
