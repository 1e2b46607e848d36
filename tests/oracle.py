"""Spark results beside DuckDB's, value by value."""

import os

import duckdb
import pandas as pd

DATA = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def connect(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def text_of(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return "null"
    if isinstance(v, float):
        return f"{v + 0.0:.6g}"
    if isinstance(v, bool) or type(v).__name__ in ("bool_", "int64", "int32", "int16", "int8"):
        return str(int(v))
    return str(v)


def plain(df):
    df = df[sorted(df.columns)].map(text_of)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def assert_same(spark_df, con, sql):
    got, expected = plain(spark_df.toPandas()), plain(con.execute(sql).df())
    assert list(got.columns) == list(expected.columns)
    assert len(got) == len(expected)
    differ = got[(got != expected).any(axis=1)] if len(got) else got
    assert differ.empty, f"{differ.head(3)}\n{expected.loc[differ.index].head(3)}"
