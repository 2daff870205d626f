"""Runs a query's DuckDB statement over the tables of a folder."""

import os

import duckdb
import pandas as pd

DATA = "/root/testdata/sf0.001"


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(folder):
        path = f"{folder}/{f}"
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def cell(v) -> str:
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return "null"
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return str(bool(v))
    if isinstance(v, (int, float)) or type(v).__name__.startswith(("int", "float", "Decimal")):
        return repr(round(float(v), 6) + 0.0)
    return str(v)


def normal(df: pd.DataFrame) -> list[tuple[str, ...]]:
    columns = sorted(df.columns)
    return [tuple(columns), *sorted(tuple(cell(v) for v in r) for r in df[columns].itertuples(index=False))]
