"""Comparison of a query's rows with those of its SQL."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in Path(folder).iterdir():
        con.sql(f"create view {f.name.split('.')[0]} as select * from '{f}'")
    return con


def norm(v):
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(map(norm, v))
    if v is None or v is pd.NA or (isinstance(v, float) and v != v):
        return None
    if hasattr(v, "item"):
        v = v.item()
    return v if isinstance(v, bool) or not isinstance(v, (int, float)) else round(float(v) + 0.0, 6)


def rows(df: pd.DataFrame) -> Counter:
    return Counter(repr(tuple(map(norm, r))) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


def check(spark, folder: str, query, sql: str | None) -> pd.DataFrame:
    got = query(spark, folder).toPandas()
    if sql:
        want = connect(folder).sql(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        a, b = rows(got), rows(want)
        assert a == b, (list((a - b).items())[:3], list((b - a).items())[:3])
    return got
