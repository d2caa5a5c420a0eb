"""Registered queries against their SQL on the smallest tables."""

import duckdb
import pytest

from gapline.llm import queries

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations"):
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SMALL)
    names = sorted(df.columns)
    got = sorted(map(tuple, df.select(names).collect()), key=repr)
    assert got == sorted(con.sql(f"select {', '.join(names)} from ({queries.SQL[name]})").fetchall(), key=repr)
