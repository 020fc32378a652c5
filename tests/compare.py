"""Runs a registered query and its SQL side by side, as the driver does."""

from __future__ import annotations

import math

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return c


def _plain(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(map(_plain, v))
    if isinstance(v, pd.Timestamp):
        return v.tz_localize(None).isoformat()
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return v


def rows_of(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(map(_plain, r)) for r in frame.itertuples(index=False, name=None)), key=repr)


def differences(spark_frame: pd.DataFrame, sql_frame: pd.DataFrame) -> str:
    """Empty if both have the same columns and rows."""
    if sorted(spark_frame.columns) != sorted(sql_frame.columns):
        return f"columns {sorted(spark_frame.columns)} against {sorted(sql_frame.columns)}"
    kinds = lambda f: {c: "f" if str(f[c].dtype).startswith("float") else "i" if "int" in str(f[c].dtype).lower() else "o" for c in f}
    a, b = rows_of(spark_frame), rows_of(sql_frame)
    if a == b:
        return ""
    only = [x for x in a if x not in set(b)][:2], [x for x in b if x not in set(a)][:2]
    return f"{len(a)} rows against {len(b)}; only in Spark {only[0]!r:.600}; only in SQL {only[1]!r:.600}; kinds {kinds(spark_frame)} {kinds(sql_frame)}"
