"""Compare a query with its SQL: same columns, same rows in any order."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for name in TABLES:
        path = os.path.join(sf_dir, f"{name}.parquet")
        if os.path.exists(path):
            con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(value):
    if isinstance(value, bool) or value is None:
        return str(value)
    if hasattr(value, "is_integer") or type(value).__name__ == "Decimal":
        number = float(value)
        return "nan" if math.isnan(number) else f"{number + 0.0:.6f}"
    if isinstance(value, int):
        return f"{value:d}"
    return str(value)


def _rows(columns, rows, floats):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = []
    for row in rows:
        out.append(tuple(
            (f"{float(row[i]) + 0.0:.6f}" if columns[i] in floats and row[i] is not None else _cell(row[i])) for i in order
        ))
    return [columns[i] for i in order], sorted(out)


def compare(spark_df, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """Empty if equal, else a short description of the first difference."""
    floats = {n for n, t in spark_df.dtypes if t in ("double", "float")}
    got_columns, got = _rows(spark_df.columns, spark_df.collect(), floats)
    rel = con.sql(sql)
    want_columns, want = _rows(rel.columns, rel.fetchall(), floats)
    if got_columns != want_columns:
        return f"columns {got_columns} != {want_columns}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)} rows"
    for a, b in zip(got, want):
        if a != b:
            return f"{str(a)[:600]}\n   != {str(b)[:600]}"
    return "" if got else "EMPTY"
