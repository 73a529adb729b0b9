"""Run a query and its DuckDB counterpart on the same tables and compare the rows."""

import glob
import os

import duckdb
import pandas as pd


def connect(data):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for path in glob.glob(f"{data}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def rows(frame):
    def plain(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return "-"
        return f"{v:.9g}" if isinstance(v, float) else str(v)

    columns = sorted(frame.columns)
    return columns, sorted(tuple(plain(v) for v in r) for r in frame[columns].astype(object).itertuples(index=False))


def same(spark, data, query, sql):
    expected = connect(data).sql(sql).df()
    assert rows(query(spark, data).toPandas()) == rows(expected)
