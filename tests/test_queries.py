"""Every query that SQL can express, against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

from bytestrata.plans import registry

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{DIR}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    df = registry.QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    rows = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    if name not in registry.SQL:
        assert rows
        return
    assert sorted(con.sql(registry.SQL[name]).columns) == columns
    assert rows == sorted(map(repr, con.sql(f"SELECT {', '.join(columns)} FROM ({registry.SQL[name]})").fetchall()))


def test_runs_with_unknown_offsets(spark, tmp_path):
    """Lines without a number come last in their order, as in the SQL; none of these rows leaves the SQL's result open."""
    rows = [(1, 1, 1), (1, 1, None), (1, 2, 2), (1, 1, None), (1, 1, 4), (2, 1, None), (None, 1, 2), (None, 1, 1), (None, 1, None), (3, 5, 1), (3, None, 2), (3, -4, 3)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    found = registry.QUERIES["slice_merge_runs"](spark, str(tmp_path)).select("name", "run_no", "off", "len", "pieces").collect()
    c = duckdb.connect()
    c.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
    sql = c.execute(f"SELECT name, run_no, off, len, pieces FROM ({registry.SQL['slice_merge_runs']})").fetchall()
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, sql))
    assert [tuple(r)[1:] for r in sorted(found, key=lambda r: r.run_no) if r.name == 1] == [(1, 0, 200, 2), (2, 300, 100, 1), (3, None, 100, 1), (4, None, 100, 1)]


def test_runs_of_tied_pieces(spark, tmp_path):
    """Where the SQL's order leaves ties open, the rows get one result however they lie: that of ties taken in one order in both windows."""
    rows = [(k, 1, n) for k in range(200) for n in (1, 2, 2, 3, 3, 3, 5, 5)]
    want = [(1, 0, 200, 2), (2, 100, 200, 2), (3, 200, 100, 1), (4, 200, 100, 1), (5, 400, 100, 1), (6, 400, 100, 1)]
    for n in (1, 7):
        lines = spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_linenumber int").repartition(n)
        lines.write.parquet(f"{tmp_path}/{n}/lineitem.parquet")
        found = registry.QUERIES["slice_merge_runs"](spark, f"{tmp_path}/{n}").select("name", "run_no", "off", "len", "pieces").collect()
        assert sorted(map(tuple, found)) == [(k, *r) for k in range(200) for r in want]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(registry.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
