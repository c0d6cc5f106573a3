"""Names and projections of wide weekly tables.

Defined results: a NULL source or series gives a NULL name; a table without rows keeps no column but its keys, as no value
is known; columns that match several patterns come once.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Price fields that a provider does not adjust, and what their names say.
RAW_FIELDS = ("open", "high", "low", "close")
#: Bond, commodity and currency funds, which are no equities.
NON_EQUITY = ("shy", "ief", "tlt", "hyg", "lqd", "gld", "uup")


def column_name(source: Column, series: Column, market: str) -> Column:
    """The column of a series: <symbol>_close for adjusted closes, <symbol>_raw_<field> for raw prices, <symbol>_<field> for
    other market fields, and the lower-case id for any other source."""
    parts = F.split(series, r"\.", 2)
    symbol, field = F.lower(parts[0]), parts[1]
    named = F.when(field == "adjusted_close", F.concat(symbol, F.lit("_close"))).when(field.isin(*RAW_FIELDS), F.concat(symbol, F.lit("_raw_"), field)).otherwise(F.concat(symbol, F.lit("_"), field))
    return F.when(source == market, named).otherwise(F.lower(series))


def required_series(symbols: DataFrame, fields: list[str], macro: DataFrame, market: str, other: str) -> DataFrame:
    """(source, series_id): every field of every symbol (column symbol), and the ids of ``macro`` (column id)."""
    field = F.explode(F.array(*[F.lit(f) for f in fields]))
    market_rows = symbols.select(F.lit(market).alias("source"), "symbol", field.alias("field")).select("source", F.concat_ws(".", "symbol", "field").alias("series_id"))
    return market_rows.unionByName(macro.select(F.lit(other).alias("source"), F.col("id").alias("series_id")))


def equities(panel: DataFrame, stem: str = "series_id") -> DataFrame:
    """Rows of series that count for equity breadth."""
    return panel.filter(~F.lower(stem).isin(*NON_EQUITY))


def select_columns(frame: DataFrame, keys: list[str], patterns: list[str]) -> DataFrame:
    """The keys and the columns that match a pattern and hold a value anywhere; one aggregation finds these."""
    chosen = [c for c in frame.columns if c not in keys and any(re.search(p, c) for p in patterns)]
    if not chosen:
        return frame.select(*keys)
    known = frame.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in chosen]).first()
    return frame.select(*keys, *[F.col(f"`{c}`") for c in chosen if known[c]])
