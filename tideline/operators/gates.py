"""Gates before training: whether a first history is complete, and whether a collection belongs to its cutoff's week.

Each gate gives one row for what it judges, with an array of reasons; an empty array passes. Counts are aggregations by
series or by period, so no set of periods is ever held in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Names under which credentials travel, and what replaces them.
SENSITIVE = ["api_key", "apikey", "authorization", "password", "passwd", "secret", "token", "access_token", "refresh_token"]
IN_TEXT = r"(?i)(api[_-]?key|apikey|token|password|secret)=([^&\s]+)"
REDACTED = "[REDACTED]"


def _reasons(tests: dict[str, Column]) -> Column:
    """The names of the tests that hold, in order."""
    return F.filter(F.array(*[F.when(t, n) for n, t in tests.items()]), lambda x: x.isNotNull())


def baseline_series(obs: DataFrame, expected: DataFrame, history_start: str, cutoff: str, share: float = 0.9, lag_days: int = 10) -> DataFrame:
    """(symbol, field, first, expected_periods, periods, latest, n_invalid, n_repeated, n_unequal, reasons) of every series.

    ``obs`` is (symbol, field, period, value, available_day, status), ``expected`` (symbol, field, inception); a series is
    expected from the later of its inception, where it has one, and ``history_start``, once a week. A row is invalid if its value
    is missing, its status is not ok, or its period or availability lies outside history_start .. ``cutoff``. n_unequal counts
    periods that not all fields of the symbol have. What nobody expects is a row of its own, with reason unexpected.
    """
    start, end = F.lit(history_start).cast("date"), F.lit(cutoff).cast("date")
    key = ["symbol", "field"]
    valid = F.coalesce(F.col("value").isNotNull() & (F.col("status") == "ok") & F.col("period").between(start, end) & (F.col("available_day") <= end), F.lit(False))
    by_period = obs.groupBy(*key, "period").agg(F.count(F.when(valid, 1)).alias("n"), F.count(F.when(~valid, 1)).alias("bad"))
    wanted = expected.groupBy(*key).agg(F.greatest(F.max("inception"), start).alias("first"))
    fields = wanted.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_fields"))
    held = by_period.filter("n > 0").join(wanted.select(*key), key, "left_semi").groupBy("symbol", "period").agg(F.count(F.lit(1)).alias("held"))
    unequal = held.join(fields, "symbol").filter("held < n_fields").groupBy("symbol").agg(F.count(F.lit(1)).alias("n_unequal"))
    seen = by_period.groupBy(*key).agg(
        F.count(F.when(F.col("n") > 0, 1)).alias("periods"), F.max(F.when(F.col("n") > 0, F.col("period"))).alias("latest"), F.sum("bad").alias("n_invalid"),
        F.sum(F.greatest(F.col("n") - 1, F.lit(0))).alias("n_repeated"), F.lit(True).alias("_seen"),
    )
    rows = wanted.withColumn("_wanted", F.lit(True)).join(seen, key, "full").join(unequal, "symbol", "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("periods", "n_invalid", "n_repeated", "n_unequal")}
    rows = rows.withColumns(zero | {"expected_periods": F.when(F.col("_wanted"), F.greatest(F.floor(F.datediff(end, "first") / 7) + 1, F.lit(0)))})
    least = F.greatest(F.lit(1), F.ceil(F.round(F.col("expected_periods") * share, 9)))
    tests = {
        "unexpected": F.col("_wanted").isNull(),
        "missing": F.col("_wanted") & (F.col("periods") == 0),
        "insufficient": F.col("_wanted") & (F.col("periods") < least),
        "stale": F.col("_wanted") & F.coalesce(F.col("latest") < F.date_sub(end, lag_days), F.lit(True)),
        "fields_differ": F.col("_wanted") & (F.col("n_unequal") > 0),
        "invalid": F.col("_wanted") & (F.col("n_invalid") > 0),
        "repeated": F.col("_wanted") & (F.col("n_repeated") > 0),
    }
    return rows.select(*key, "first", "expected_periods", "periods", "latest", "n_invalid", "n_repeated", "n_unequal", _reasons(tests).alias("reasons"))


def baseline_gate(series: DataFrame) -> DataFrame:
    """One row over ``baseline_series``: counts of series by reason, and whether all of them pass; no series at all do not."""
    names = ("unexpected", "missing", "insufficient", "stale", "fields_differ", "invalid", "repeated")
    has = [F.count(F.when(F.array_contains("reasons", n), 1)).alias(f"n_{n}") for n in names]
    return series.agg(F.count(F.lit(1)).alias("n_series"), *has, F.coalesce(F.bool_and(F.size("reasons") == 0), F.lit(False)).alias("passed"))


def in_market_week(coverage_end: Column, available_at: Column, cutoff: Column, zone: str = "America/New_York") -> Column:
    """Whether the last day covered lies in the cutoff's week up to its day, and became available on that day at the cutoff's
    time of day, both local, and not after the cutoff: a Thursday before a holiday passes, an earlier week never does."""
    at, available = F.convert_timezone(F.lit("UTC"), F.lit(zone), cutoff), F.convert_timezone(F.lit("UTC"), F.lit(zone), available_at)
    clock = lambda t: F.date_format(t, "HH:mm:ss.SSSSSS")
    inside = coverage_end.between(F.trunc(at, "week"), at.cast("date"))
    return F.coalesce(inside & (available.cast("date") == coverage_end) & (clock(available) == clock(at)) & (available_at <= cutoff), F.lit(False))


def collection_gate(sources: DataFrame, keys: list[str], expected: list[str], market: str) -> DataFrame:
    """(keys, reasons) of collections (keys, cutoff, source, status, issues, coverage_end, available_at); times are UTC without zone.

    A collection passes if it holds exactly the expected sources, once each, all ok and without issues, and if the source
    ``market`` has reached the cutoff's market week.
    """
    own = F.col("source") == market
    current = own & in_market_week(F.col("coverage_end"), F.col("available_at"), F.col("cutoff"))
    strange = ~F.coalesce(F.col("source").isin(expected), F.lit(False))
    found = sources.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(strange, 1)).alias("strange"), F.countDistinct(F.when(~strange, F.col("source"))).alias("known"),
        F.count(F.when(~F.coalesce(F.col("status") == "ok", F.lit(False)), 1)).alias("ill"), F.count(F.when(F.size(F.coalesce("issues", F.array())) > 0, 1)).alias("noted"),
        F.count(F.when(current, 1)).alias("current"), F.countDistinct("cutoff").alias("cutoffs"),
    )
    tests = {
        "sources": (F.col("strange") > 0) | (F.col("known") != len(expected)) | (F.col("n") != len(expected)),
        "cutoff": F.col("cutoffs") != 1,
        "status": F.col("ill") > 0,
        "issues": F.col("noted") > 0,
        "market_week": F.col("current") == 0,
    }
    return found.select(*keys, _reasons(tests).alias("reasons"))


def redact_text(text: Column, secrets: tuple[str, ...] = ()) -> Column:
    """``text`` without the values of credentials in query strings, and without each of ``secrets``."""
    safe = F.regexp_replace(text, IN_TEXT, rf"$1={REDACTED}")
    for secret in filter(None, secrets):
        safe = F.replace(safe, F.lit(secret), F.lit(REDACTED))
    return safe


def _sensitive(name: Column) -> Column:
    plain = F.replace(F.lower(F.trim(name)), F.lit("-"), F.lit("_"))
    return plain.isin(SENSITIVE) | plain.endswith("_token")


def _is_sensitive(name: str) -> bool:
    plain = name.strip().lower().replace("-", "_")
    return plain in SENSITIVE or plain.endswith("_token")


def _sanitized(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StringType):
        return redact_text(value)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _sanitized(x, kind.elementType))
    if isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        hidden = F.lit(REDACTED) if isinstance(kind.valueType, T.StringType) else F.lit(None)
        return F.transform_values(value, lambda k, v: F.when(_sensitive(k), hidden).otherwise(_sanitized(v, kind.valueType)))
    if isinstance(kind, T.StructType):
        parts = [_hidden(f.dataType) if _is_sensitive(f.name) else _sanitized(value[f.name], f.dataType) for f in kind.fields]
        return F.when(value.isNotNull(), F.struct(*[p.alias(f.name) for p, f in zip(parts, kind.fields, strict=True)]))
    return value


def _hidden(kind: T.DataType) -> Column:
    return F.lit(REDACTED) if isinstance(kind, T.StringType) else F.lit(None).cast(kind)


def sanitize(frame: DataFrame) -> DataFrame:
    """``frame`` without credentials at any depth of its structs, maps and arrays.

    A field or key with a credential's name holds REDACTED whatever was there, or NULL where it is no text; in all other texts
    the values of credentials in query strings go. Names and types stay, and so does every other NULL.
    """
    return frame.select(*[(_hidden(f.dataType) if _is_sensitive(f.name) else _sanitized(F.col(f"`{f.name}`"), f.dataType)).alias(f.name) for f in frame.schema.fields])
