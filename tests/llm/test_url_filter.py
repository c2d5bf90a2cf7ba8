import random

import duckdb
import pandas as pd

from quadrille.llm.url_filter import OP1_SQL, filter_urls, op1_url_filter

URLS = [
    (1, "https://A.Example.ORG/es/1?x#y"), (2, "http://example.org/en/1"), (3, "http://example.org/en/2"), (4, "ftp://www.com/fr/"), (5, "http://x.com/de/a"), (6, None), (7, ""), (8, "no scheme/org/"), (9, "http://foo.org"),
    (10, "http://org/"), (11, "http://notorg/"), (12, "http://HOST?q://z/p"), (13, "http://é.net/ü" + "a" * 5000), (14, "a://b://c/d"), (15, "http://x.com/DE/a"), (16, "http://x.com/DE/a"),
]


def test_hosts_paths_and_rules(spark):
    pages = spark.createDataFrame([(i, u, "h", "t", "v") for i, u in URLS], "page_id long, url string, host string, text string, verdict string")
    got = {r.page_id: r for r in filter_urls(pages).collect()}
    assert len(got) == len(URLS)
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert [got[i].rule for i in (2, 3, 4, 5)] == ["example.org/en/1", "org/", "com/fr/", "com/de/"]
    assert [(got[i].host, got[i].path) for i in (6, 7, 8)] == [("", "")] * 3
    assert [got[i].rule for i in (9, 10, 11, 15)] == [None, "org/", None, None]
    assert (got[12].host, got[12].path) == ("host", "") and (got[14].host, got[14].path) == ("b:", "//c/d")
    assert all(r.verdict in ("allow", "block") for r in got.values())
    assert filter_urls(pages.limit(0)).count() == 0


def test_the_model_tells_apart_what_the_rules_taught(spark):
    r = random.Random(7)
    name = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    rows = [(i, f"http://{name()}.org/good/{name()}") for i in range(300)] + [(1000 + i, f"http://{name()}.com/de/bad/{name()}") for i in range(300)] + [(5000, "http://abc.net/good/fgh"), (5001, "http://abc.net/de/bad/fgh")]
    got = {r.page_id: r.verdict for r in filter_urls(spark.createDataFrame(rows, "page_id long, url string")).where("page_id >= 5000").collect()}
    assert got == {5000: "allow", 5001: "block"}


def test_query_agrees_with_its_sql(spark, tmp_path):
    rows = URLS + [(100 + i, f"http://s{i % 7}.{'org' if i % 3 else 'com'}/{'de' if i % 2 else 'fr'}/{i}") for i in range(200)]
    pd.DataFrame(rows, columns=["page_id", "url"]).to_parquet(tmp_path / "pages.parquet")
    db = duckdb.connect()
    db.sql(f"create view pages as select * from '{tmp_path}/pages.parquet'")
    assert sorted(map(tuple, op1_url_filter(spark, str(tmp_path)).collect()), key=str) == sorted(db.sql(OP1_SQL).fetchall(), key=str)
