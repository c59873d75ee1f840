"""Spark results held against DuckDB's on the same files."""

import os

import duckdb
import pandas as pd

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def duck(sf_dir: str = SF) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        path = f"{sf_dir}/{f}" if os.path.isfile(f"{sf_dir}/{f}") else f"{sf_dir}/{f}/*.parquet"
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    return con


def plain(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df:
        if df[c].dtype.kind in "fiu" or str(df[c].dtype) in ("Int32", "Int64"):
            df[c] = df[c].astype("float64").round(5) + 0.0
    return df.astype(str).sort_values(list(df.columns)).reset_index(drop=True)


def assert_same(got: pd.DataFrame, expected: pd.DataFrame) -> None:
    pd.testing.assert_frame_equal(plain(got), plain(expected))
