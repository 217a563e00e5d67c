"""Run a query in Spark and its SQL in DuckDB and compare names, rows and values."""

from __future__ import annotations

import datetime
import decimal
import math
from pathlib import Path

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = Path(folder) / f"{t}.parquet"
        if path.exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    return v


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    data = [tuple(plain(row[i]) for i in order) for row in rows]
    key = lambda row: tuple((v is not None, type(v).__name__ if not isinstance(v, (int, float)) else "n", v if v is not None else 0) for v in row)
    return [columns[i] for i in order], sorted(data, key=key)


def differences(spark_df, con, sql: str, exact: bool = True) -> list[str]:
    """Empty when both sides agree."""
    got_names, got = table(spark_df.columns, spark_df.collect())
    cur = con.execute(sql)
    want_names, want = table([d[0] for d in cur.description], cur.fetchall())
    if got_names != want_names:
        return [f"columns {got_names} against {want_names}"]
    if len(got) != len(want):
        return [f"{len(got)} rows against {len(want)}"]
    out = []
    for a, b in zip(got, want):
        for name, x, y in zip(got_names, a, b):
            if x != y and not (not exact and isinstance(x, float) and isinstance(y, (int, float))
                               and math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9)):
                out.append(f"{name}: {x!r} against {y!r} in {a}")
    return out
