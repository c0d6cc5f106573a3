"""Rows of a query beside those of its DuckDB SQL."""

from __future__ import annotations

import decimal
from collections import Counter
from pathlib import Path

import duckdb

DIGITS = 6


def plain(value):
    """Numbers of any type as rounded floats, other values as text, so that both engines print alike."""
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (int, float, decimal.Decimal)):
        return round(float(value), DIGITS) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return str(value)


def oracle_rows(sf_dir: str, sql: str) -> tuple[list[str], Counter]:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), Counter(tuple(plain(row[k]) for k in order) for row in found.fetchall())


def query_rows(df) -> tuple[list[str], Counter]:
    names = sorted(df.columns)
    return names, Counter(tuple(plain(row[n]) for n in names) for row in df.collect())
