"""Local twin of the driver's correctness check: Spark result vs DuckDB oracle.

Compares row count, column names and an order-insensitive hash of the
values (columns sorted by name).  Used by tests; small results only.
"""

from __future__ import annotations

import hashlib
import math
import os

import duckdb
import pandas as pd

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def duckdb_conn(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        if math.isnan(v):
            return "NULL"
        return repr(v)
    if hasattr(v, "isoformat"):
        return v.isoformat(sep=" ") if hasattr(v, "hour") else v.isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    return str(v)


def digest(columns: list[str], rows: list[tuple]) -> tuple[int, list[str], str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cols = [columns[i] for i in order]
    lines = sorted("|".join(_norm(r[i]) for i in order) for r in rows)
    h = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return len(lines), cols, h


def compare(spark_df, sql: str, sf_dir: str) -> dict:
    s_rows = [tuple(r) for r in spark_df.collect()]
    s_cols = list(spark_df.columns)
    rel = duckdb_conn(sf_dir).sql(sql)
    d_cols = list(rel.columns)
    d_rows = rel.fetchall()
    sn, sc, sh = digest(s_cols, s_rows)
    dn, dc, dh = digest(d_cols, d_rows)
    return {"rows": (sn, dn), "cols_match": sc == dc, "cols": (sc, dc), "hash_match": sh == dh,
            "spark": pd.DataFrame(s_rows, columns=s_cols), "oracle": pd.DataFrame(d_rows, columns=d_cols)}
