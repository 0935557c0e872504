"""Every registered graph query against its SQL at the smallest scale."""

import os

import duckdb
import pytest

from weftline.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no sample tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    got = registry.queries()[name](spark, DATA)
    want = duck.sql(registry.oracle_sql()[name])
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    nulls_last = lambda row: [(v is None, 0 if v is None else v) for v in row]
    a = sorted((tuple(r[c] for c in names) for r in got.collect()), key=nulls_last)
    at = [want.columns.index(c) for c in names]
    b = sorted((tuple(r[k] for k in at) for r in want.fetchall()), key=nulls_last)
    assert a == b


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["degree", "cnt"]
