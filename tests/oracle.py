"""Compares a query's rows with those of its SQL in DuckDB on the same tables."""

import glob
import os

import duckdb

SF_DIR = "/root/testdata/sf0.001"


def connect(sf_dir: str = SF_DIR) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def rounded(value):
    return round(value, 6) if isinstance(value, float) else value


def compare(spark, query, sql: str, sf_dir: str = SF_DIR) -> list[tuple]:
    """The rows, which are the same for both; columns in order of their names."""
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    got = [tuple(rounded(r[n]) for n in names) for r in df.collect()]
    result = connect(sf_dir).execute(sql)
    columns = [x[0] for x in result.description]
    assert sorted(columns) == names
    want = [tuple(rounded(r[columns.index(n)]) for n in names) for r in result.fetchall()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    return got
