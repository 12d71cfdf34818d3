"""Spark's rows against DuckDB's, by value and without regard to order."""

import glob
import os

import duckdb
import pandas as pd

SF = "/root/testdata/sf0.001"


def connected(sf_dir=SF):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def rows(frame):
    def plain(v):
        if v is None or v is pd.NA or v is pd.NaT or v != v:
            return None
        return round(float(v), 6) if isinstance(v, float) and v != int(v) else int(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v.item() if hasattr(v, "item") else v

    names = sorted(frame.columns)
    return sorted((tuple(plain(v) for v in r) for r in frame[names].astype(object).itertuples(index=False)), key=repr)
