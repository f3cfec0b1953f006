"""Order-insensitive comparison of a Spark result with DuckDB's."""

from __future__ import annotations

import math

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def shown(v) -> str:
    if hasattr(v, "tolist") and not isinstance(v, str):
        v = v.tolist()
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    return f"{v:.6f}" if isinstance(v, float) else str(v)


def rows(df: pd.DataFrame) -> list[tuple[str, ...]]:
    ordered = df[sorted(df.columns)]
    return sorted(tuple(shown(v) for v in r) for r in ordered.itertuples(index=False))
