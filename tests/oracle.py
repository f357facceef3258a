"""Compares a query's rows with those of its SQL, numbers within a millionth."""

import math
import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{folder}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return None
    if type(v).__name__ in ("bool", "bool_"):
        return bool(v)
    return float(f"{float(v):.8g}") if isinstance(v, float) or type(v).__name__ == "Decimal" else v


def rows(df: pd.DataFrame) -> list[tuple]:
    columns = [[plain(v) for v in df[c].astype(object)] for c in sorted(df.columns)]
    return sorted(zip(*columns), key=lambda r: tuple((v is None, str(v)) for v in r))


def same(a: pd.DataFrame, b: pd.DataFrame) -> None:
    assert sorted(a.columns) == sorted(b.columns)
    x, y = rows(a), rows(b)
    assert len(x) == len(y)
    for p, q in zip(x, y):
        for u, v in zip(p, q):
            number = isinstance(u, (int, float)) and isinstance(v, (int, float))
            assert u == v or (number and math.isclose(u, v, rel_tol=1e-6, abs_tol=1e-9)), (p, q)
