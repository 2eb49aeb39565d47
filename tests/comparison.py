"""Holds a Spark result against a DuckDB query on the same Parquet tables."""

import datetime
import decimal
import math
from pathlib import Path

import duckdb


def oracle(sql: str, sf_dir: str):
    """Column names and rows."""
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    got = con.execute(sql)
    return [c[0] for c in got.description], got.fetchall()


def plain(x):
    """A value as both engines would show it."""
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, (int, float, decimal.Decimal)):
        x = float(x)
        return None if math.isnan(x) else f"{0.0 if abs(x) < 5e-10 else x:.9g}"
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, datetime.date):
        return x.isoformat()
    if isinstance(x, (list, tuple)):
        return [plain(v) for v in x]
    if isinstance(x, dict):
        return sorted((str(k), str(plain(v))) for k, v in x.items())
    return x


def table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(([plain(r[i]) for i in order] for r in rows), key=repr)


def differences(df, sql: str, sf_dir: str) -> str:
    """Empty if the result is the oracle's, else what differs first."""
    names, rows = table(df.columns, [tuple(r) for r in df.collect()])
    want_names, want = table(*oracle(sql, sf_dir))
    if names != want_names:
        return f"columns {names}, not {want_names}"
    if len(rows) != len(want):
        return f"{len(rows)} rows, not {len(want)}"
    bad = [(a, b) for a, b in zip(rows, want, strict=True) if a != b]
    return f"{len(bad)} of {len(rows)} rows differ, the first {bad[0][0]}, not {bad[0][1]}" if bad else ""
