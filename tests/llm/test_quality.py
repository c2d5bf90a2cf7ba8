import re
from collections import Counter

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quadrille.llm.quality import OP6_SQL, bucket, bucket_value, op6_quality, quality_filter, quality_table, text_measures

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(text):
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    many = Counter(windows)
    covered = {j for i, w in enumerate(windows) if many[w] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), len(lines)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab \n\t\x0b\x1cé #$中"), max_size=120))
def test_measures(text):
    assert text_measures(text.encode()) == brute(text)


def test_buckets_are_ordered_and_invertible(spark):
    df = spark.range(0, 5000).select(F.col("id").alias("v")).union(spark.sql("select explode(array(10000L, 123456L, 99999999999L)) v"))
    rows = df.select("v", bucket(F.col("v")).cast("long").alias("b")).select("v", "b", bucket_value(F.col("b")).alias("low")).orderBy("v").collect()
    for a, b in zip(rows, rows[1:]):
        assert a.b <= b.b
    assert all(r.low <= r.v <= r.low * 1.04 + 1 for r in rows) and all(r.low == r.v for r in rows if r.v < 64)


@pytest.fixture(scope="module")
def mixed(make_docs):
    clean = [(i, " ".join(f"word{(i * 31 + j * j) % 997}" for j in range(60)), "en", "a") for i in range(150)]
    junk = [(200 + i, " ".join(f"word{(i * 7 + j * j) % 991}$$$" for j in range(60)), "en", "a") for i in range(5)]
    odd = [(300, None), (301, ""), (302, "short"), (303, " ".join("same words again and again".split() * 20)), (304, " ".join(f"word{i}" for i in range(10, 22)), None, None), (304, " ".join(f"word{i}" for i in range(10, 22)), None, None)]
    return make_docs(clean + junk + odd)


def test_table(mixed):
    rows = quality_table(mixed).collect()
    assert len(rows) == mixed.count()
    kept = {r.doc_id: r.kept for r in rows}
    assert all(kept[i] for i in range(150)) and not any(kept[200 + i] for i in range(5))
    assert [kept[i] for i in (300, 301, 302, 303)] == [False] * 4 and kept[304]
    assert quality_table(mixed.limit(0)).count() == 0


def test_junk_does_not_widen_its_own_limit(make_docs):
    """A fifth of a source is junk, which would be within four widths of its own upper quantiles."""
    clean = [(i, " ".join(f"word{(i * 31 + j * j) % 997}" for j in range(60)), "en", "spam") for i in range(160)]
    junk = [(500 + i, " ".join(f"word{(i * 7 + j * j) % 991}" + "$" * (j % (2 + i % 5) == 0) for j in range(60)), "en", "spam") for i in range(40)]
    kept = {r.doc_id: r.kept for r in quality_table(make_docs(clean + junk)).collect()}
    assert all(kept[i] for i, *_ in clean) and not any(kept[i] for i, *_ in junk)


def test_long_texts(make_docs):
    words = " ".join(f"w{i * i % 99991}" for i in range(300_000))
    row = quality_table(make_docs([(1, words)])).first()
    assert (row.n_words, row.n_lines) == (300_000, 1) and row.word_chars == len(words.replace(" ", ""))


def test_filter_keeps_columns_and_agrees(mixed):
    out = quality_filter(mixed)
    assert out.columns == mixed.columns
    kept = sorted(r.doc_id for r in quality_table(mixed).where("kept").collect())
    assert sorted(r.doc_id for r in out.collect()) == kept


def test_query_agrees_with_its_sql(spark, mixed, tmp_path):
    mixed.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(map(tuple, op6_quality(spark, str(tmp_path)).collect())) == sorted(db.sql(OP6_SQL).fetchall())
