"""Every registered element query against its SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from quadrille.plans import catalogue

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events".split()

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, db, name):
    df = catalogue.QUERIES[name](spark, str(DATA))
    names = sorted(df.columns)
    got = sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)
    if name not in catalogue.ORACLE_SQL:
        assert got
        return
    want = db.sql(catalogue.ORACLE_SQL[name])
    assert sorted(want.columns) == names
    at = [want.columns.index(n) for n in names]
    assert got == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=repr)


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["id", "metres"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
