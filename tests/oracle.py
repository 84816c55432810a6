"""Compares a query's rows with DuckDB's rows of its SQL on the same tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    if hasattr(x, "item"):
        x = x.item()
    if isinstance(x, float):
        return 0.0 if abs(x) < 5e-7 else float(f"{x:.9g}")
    if hasattr(x, "isoformat"):
        return x.isoformat()
    return x


def rows_of(columns: list[str], rows: list) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(([plain(r[i]) for i in order] for r in rows), key=repr)


def equal(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, int | float) or isinstance(b, float) and isinstance(a, int | float):
        return math.isclose(a, b, rel_tol=1e-7, abs_tol=2e-6)
    return a == b


def difference(spark, query, sql: str, sf_dir: str) -> str:
    """What differs; empty if nothing does."""
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.sql(sql)
    want_cols, want_rows = rows_of(want.columns, want.fetchall())
    df = query(spark, sf_dir)
    got_cols, got_rows = rows_of(df.columns, df.collect())
    if got_cols != want_cols:
        return f"columns {got_cols} against {want_cols}"
    if len(got_rows) != len(want_rows):
        return f"{len(got_rows)} rows against {len(want_rows)}"
    bad = [(g, w) for g, w in zip(got_rows, want_rows, strict=True) if not all(map(equal, g, w))]
    return f"{len(bad)} of {len(got_rows)} rows differ in {got_cols}: {bad[0]}" if bad else ""
