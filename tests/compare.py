"""Hold a query against its SQL in DuckDB."""

import os

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        con.sql(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def _text(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and np.isnan(v)):
        return ""
    if isinstance(v, (float, np.floating)):
        return repr(float(v) if v != int(v) else float(int(v))) if np.isfinite(v) else str(v)
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (int, np.integer)):
        return repr(float(v))
    return str(v)[:10] if hasattr(v, "year") else str(v)


def same(a: pd.DataFrame, b: pd.DataFrame):
    assert sorted(a.columns) == sorted(b.columns)
    assert len(a) == len(b)
    rows = [sorted(map(tuple, x[sorted(x.columns)].map(_text).to_numpy())) for x in (a, b)]
    assert rows[0] == rows[1]
