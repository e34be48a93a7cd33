"""Spark result vs DuckDB SQL twin: column names, row count, order-insensitive values."""

from __future__ import annotations

import math
import os

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def _norm(v):
    if v is None:
        return ("~null",)
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, float):
        return ("~nan",) if math.isnan(v) else round(v, 6) + 0.0
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if hasattr(v, "isoformat"):
        return v.isoformat(sep=" ") if hasattr(v, "hour") else v.isoformat()
    return v


def canonical(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in records), key=repr)


def duckdb_with_tables(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def compare(df, con, sql: str) -> list[str]:
    """Problems found (empty list = equal)."""
    cols = df.columns
    srows = [tuple(r) for r in df.collect()]
    rel = con.sql(sql)
    dcols, drows = rel.columns, rel.fetchall()
    problems = []
    if sorted(cols) != sorted(dcols):
        problems.append(f"columns {sorted(cols)} vs {sorted(dcols)}")
    if len(srows) != len(drows):
        problems.append(f"rows {len(srows)} vs {len(drows)}")
    if not problems and canonical(cols, srows) != canonical(dcols, drows):
        a, b = canonical(cols, srows), canonical(dcols, drows)
        diff = [(x, y) for x, y in zip(a, b) if x != y][:2]
        problems.append(f"values differ, e.g. {str(diff)[:600]}")
    return problems
