"""Comparison of a query with its SQL on the same Parquet files."""

import os

import duckdb
import pandas as pd

DATA = "/root/testdata/sf0.001"


def connection(folder=DATA):
    con = duckdb.connect()
    for f in sorted(os.listdir(folder)):
        con.execute(f"create view {f[:-8]} as select * from read_parquet('{folder}/{f}')")
    return con


def plain(value):
    if value is None or (not hasattr(value, "__len__") and pd.isna(value)):
        return None
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, float) and not value.is_integer():
        return round(value, 5)
    return int(value) if isinstance(value, float) else value


def rows_of(frame):
    frame = frame[sorted(frame.columns)]
    return sorted([tuple(map(plain, r)) for r in frame.itertuples(index=False)], key=str)
