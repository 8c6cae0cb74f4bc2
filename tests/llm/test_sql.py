"""The queries that have SQL give the same rows as DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from arbiterq.llm import queries

SF = "/root/testdata/sf0.001"


def plain(v):
    return "None" if v is None or v != v else f"{v:.6f}" if isinstance(v, float) else str(v)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    want = con.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    df = queries.queries()[name](spark, SF)
    assert sorted(columns) == sorted(df.columns)
    rows = sorted(tuple(plain(x) for x in r) for r in want.fetchall())
    assert sorted(tuple(plain(r[c]) for c in columns) for r in df.collect()) == rows
