"""Every registered query that has SQL, on the smallest tables, against DuckDB."""

import decimal
import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    return v


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(([plain(r[i]) for i in order] for r in rows), key=repr)


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = table(df.columns, [tuple(r) for r in df.collect()])
    cur = duck.execute(SQL[name])
    want = table([d[0] for d in cur.description], cur.fetchall())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    for mine, theirs in zip(*[t[1] for t in (got, want)]):
        assert mine == pytest.approx(theirs, abs=1.5e-6, rel=1e-12, nan_ok=True) if _floats(mine) else mine == theirs


def _floats(row):
    return all(isinstance(v, (int, float)) for v in row)


def test_eligibility_whatever_the_order_keys(spark, tmp_path):
    """Six orders whose keys fall, cross a multiple of 1500 or rise with the date, and one on a single date."""
    name = "C2_eligibility_by_orders"
    keys = [range(2990, 2984, -1), [1490, 2990, 4490, 1, 2, 3], range(7000, 7006), range(9000, 9006)]
    dates = [f"{year}-0{month}-05 00:00:00" for month, year in enumerate((1960, 1971, 1993, 2008, 2010, 9998), 1)]
    rows = [
        (key, cust, "O", at if cust < 3 else dates[0], "1-URGENT")
        for cust, mine in enumerate(keys)
        for key, at in zip(mine, dates)
    ]
    schema = "o_orderkey long, o_custkey long, o_orderstatus string, at string, o_orderpriority string"
    orders = spark.createDataFrame(rows, schema).selectExpr("*", "CAST(at AS timestamp_ntz) AS o_orderdate").drop("at")
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    want = sorted(con.execute(SQL[name]).fetchall())
    assert [r[0] for r in want] == ["c0", "c1", "c2"]
    assert sorted(tuple(r) for r in QUERIES[name](spark, str(tmp_path)).collect()) == want


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
