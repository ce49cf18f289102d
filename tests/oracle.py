"""Runs queries beside their DuckDB SQL and compares rows without regard to order."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def canonical(df: pd.DataFrame) -> list[tuple]:
    def value(x):
        if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and x != x):
            return "~"
        if hasattr(x, "tolist"):
            x = x.tolist()
        if isinstance(x, (list, tuple)):
            return repr([value(v) for v in x])
        if isinstance(x, bool):
            return str(x)
        if isinstance(x, (int, float)) or type(x).__name__ == "Decimal":
            return f"{float(x):.9g}"
        if hasattr(x, "isoformat"):
            return pd.Timestamp(x).isoformat()
        return str(x)

    cols = sorted(df.columns)
    return sorted(tuple(value(x) for x in row) for row in df[cols].itertuples(index=False, name=None))


def difference(spark_df: pd.DataFrame, duck_df: pd.DataFrame) -> str | None:
    """What differs, or None."""
    if sorted(spark_df.columns) != sorted(duck_df.columns):
        return f"columns {sorted(spark_df.columns)} against {sorted(duck_df.columns)}"
    a, b = canonical(spark_df), canonical(duck_df)
    if len(a) != len(b):
        return f"{len(a)} rows against {len(b)}; first {a[:2]} against {b[:2]}"
    bad = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    return f"{len(bad)} of {len(a)} rows differ: {bad[:2]}" if bad else None
