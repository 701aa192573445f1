"""Comparing a query with its SQL, as unordered bags of rows."""

import math
import os
from collections import Counter

import duckdb
import pandas as pd


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for name in os.listdir(folder):
        path = f"{folder}/{name}" + ("/*.parquet" if os.path.isdir(f"{folder}/{name}") else "")
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    return con


def _plain(x):
    if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, (bool, str)):
        return x
    if hasattr(x, "isoformat"):
        return pd.Timestamp(x).isoformat()
    return round(float(x), 5) + 0.0


def bag(df: pd.DataFrame) -> tuple[list[str], Counter]:
    df = df[sorted(df.columns)]
    return list(df.columns), Counter(tuple(_plain(x) for x in row) for row in df.astype(object).itertuples(index=False, name=None))


def assert_same(spark_df, con, sql: str) -> None:
    (a, x), (b, y) = bag(spark_df.toPandas()), bag(con.execute(sql).df())
    assert a == b
    assert x == y, (list((x - y).items())[:3], list((y - x).items())[:3])
