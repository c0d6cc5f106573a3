"""Query registry of the time-series operators."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None, dates: tuple[str, ...] = ("week",)):
    """Register a query and its DuckDB SQL; the named dates and times become text on both sides, so both print alike."""

    def wrap(fn):
        @functools.wraps(fn)
        def run(spark, sf_dir):
            out = fn(spark, sf_dir)
            return out.withColumns({c: F.col(c).cast("string") for c, t in out.dtypes if t == "date"} | {c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c, t in out.dtypes if t.startswith("timestamp")})

        QUERIES[name] = run
        if oracle is not None:
            texts = ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in dates)
            ORACLES[name] = f"SELECT * REPLACE ({texts}) FROM ({oracle})" if dates else oracle
        return fn

    return wrap


def queries() -> dict:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return ORACLES
