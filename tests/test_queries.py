"""Every query with SQL gives the same rows as DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from arbiterq.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, list):
        return str([plain(x) for x in v])
    if isinstance(v, float) and v != v:
        return "None"
    return str(v)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = catalogue.queries()[name](spark, SF)
    want = con.execute(catalogue.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(df.columns)
    rows = sorted(tuple(plain(x) for x in r) for r in want.fetchall())
    assert sorted(tuple(plain(r[c]) for c in columns) for r in df.collect()) == rows


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_entry_and_names(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
