"""Null-safe numeric expressions. NULL means missing; no expression yields NaN or an infinity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

TINY = 1e-12


def min_periods(n: int) -> int:
    """Observations that a window of ``n`` rows must hold."""
    return max(2, min(n, (n + 1) // 2))


def positive_log(x: Column) -> Column:
    return F.when(x > 0, F.ln(x))


def safe_divide(a: Column, b: Column) -> Column:
    """``a / b``, or NULL where the denominator is as good as zero."""
    return F.when(F.abs(b) >= TINY, a / b)


def clip(x: Column, low: Column | float, high: Column | float) -> Column:
    low, high = (F.lit(v) if not isinstance(v, Column) else v for v in (low, high))
    return F.when(x.isNotNull(), F.least(F.greatest(x, low), high))


def finite(x: Column) -> Column:
    """NULL for NaN and infinities."""
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def rows_back(n: int, key: str = "series_id", order: str = "week") -> WindowSpec:
    return Window.partitionBy(key).orderBy(order).rowsBetween(-(n - 1), 0)


def rolling(fn, x: Column, n: int, least: int | None = None, key: str = "series_id", order: str = "week") -> Column:
    """An aggregate over the last ``n`` rows of a series, NULL below the minimum number of observations."""
    window = rows_back(n, key, order)
    return F.when(F.count(x).over(window) >= (min_periods(n) if least is None else least), fn(x).over(window))


def lag(x: Column | str, k: int, key: str = "series_id", order: str = "week") -> Column:
    return F.lag(x, k).over(Window.partitionBy(key).orderBy(order))


def rolling_z(x: Column, n: int) -> Column:
    return safe_divide(x - rolling(F.avg, x, n), rolling(F.stddev_pop, x, n))


def rounded(df, *keys: str, places: int = 6):
    """Round every double column but the keys, and drop the sign of zero."""
    return df.select(*[(F.round(F.col(n), places) + F.lit(0.0)).alias(n) if t == "double" and n not in keys else F.col(n) for n, t in df.dtypes])
