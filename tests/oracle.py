"""Compare a Spark result with a DuckDB result: columns, types and rows without order."""

from pathlib import Path

import duckdb
import pandas as pd

TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "date": "DATE"}


def duck(folder):
    con = duckdb.connect()
    for path in Path(folder).glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def cell(x):
    if x is None or x is pd.NaT or (isinstance(x, float) and x != x):
        return "-"
    return repr(round(x, 6) + 0.0) if isinstance(x, float) else str(x)


def assert_same(spark_df, con, sql):
    expected = con.sql(sql)
    names = sorted(expected.columns)
    assert sorted(spark_df.columns) == names
    types = dict(zip(expected.columns, map(str, expected.types), strict=True))
    assert {n: TYPES[t] for n, t in spark_df.dtypes} == types
    got = sorted(tuple(cell(r[n]) for n in names) for r in spark_df.collect())
    at = [expected.columns.index(n) for n in names]
    want = sorted(tuple(cell(r[i]) for i in at) for r in expected.fetchall())
    assert got == want
