"""Provider payloads as rows, and the last good history of a snapshot store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.operators.pit import normalize_revisions, redact

#: Field names of a weekly bar and what they are called here.
BAR_FIELDS = {
    "1. open": "raw_open", "2. high": "raw_high", "3. low": "raw_low", "4. close": "raw_close",
    "5. adjusted close": "close", "6. volume": "volume", "7. dividend amount": "dividend",
}


def unpivot_vintages(wide: DataFrame, period: str = "period", cells: str = "cells") -> DataFrame:
    """(series_id, observed_period_end, vintage_date, value) of a map of SERIES_YYYYMMDD cells per period.

    A cell of "." or blanks is a tombstone (null value); an absent one says that nothing changed and gives no row.
    """
    cell = wide.select(F.col(period).alias("observed_period_end"), F.explode(cells).alias("cell", "raw"))
    parts = F.regexp_extract("cell", r"^(.*)_(\d{8})$", 1), F.regexp_extract("cell", r"^(.*)_(\d{8})$", 2)
    value = F.when(~F.trim("raw").isin(".", ""), F.expr("try_cast(raw AS double)"))
    return cell.filter(parts[1] != "").select(parts[0].alias("series_id"), "observed_period_end", F.to_date(parts[1], "yyyyMMdd").alias("vintage_date"), value.alias("value"))


def explode_bars(payloads: DataFrame, symbol: str = "symbol", body: str = "body", top: str = "Weekly Adjusted Time Series") -> DataFrame:
    """(series_id, observed_period_end, value) of weekly bars in JSON: a map of dates to maps of fields."""
    parsed = F.from_json(F.get_json_object(body, f"$['{top}']"), "map<string, map<string, string>>")
    weeks = payloads.select(F.col(symbol).alias("symbol"), F.explode(parsed).alias("week", "fields"))
    each = weeks.select("symbol", F.to_date("week").alias("observed_period_end"), F.explode("fields").alias("field", "raw"))
    named = F.element_at(F.create_map(*[F.lit(x) for kv in BAR_FIELDS.items() for x in kv]), F.col("field"))
    return each.select(F.concat_ws(".", "symbol", named).alias("series_id"), "observed_period_end", F.expr("try_cast(raw AS double)").alias("value")).filter(named.isNotNull())


def last_good(snapshots: DataFrame, observations: DataFrame, keys: list[str] | None = None, quarantine: bool = True) -> DataFrame:
    """Effective history: the last full snapshot of every dataset and the deltas after it, good snapshots only.

    Deltas before any full snapshot stay invisible. With ``quarantine`` a period after its own snapshot's cutoff never
    shows. Of rows with the same identity the later snapshot's wins; revisions are numbered anew.
    """
    keys = keys or ["source", "dataset"]
    good = snapshots.filter("status = 'ok'")
    full = good.groupBy(*keys).agg(F.max(F.when(F.col("mode") == "full", F.struct("retrieved_at", "snapshot_id"))).alias("_full"))
    visible = good.join(full, keys).filter(F.struct("retrieved_at", "snapshot_id") >= F.col("_full")).select(*keys, "snapshot_id", F.col("retrieved_at").alias("snapshot_at"), "cutoff")
    rows = observations.join(visible, [*keys, "snapshot_id"])
    if quarantine:
        rows = rows.filter(F.col("observed_period_end") <= F.to_date("cutoff"))
    identity = ["source", "series_id", "observed_period_end", "vintage_date", "available_at"]
    others = [c for c in observations.columns if c not in identity]
    latest = rows.groupBy(*identity).agg(F.max_by(F.struct(*others), F.struct("snapshot_at", "snapshot_id", "retrieved_at", "revision_seq", "raw_sha256")).alias("_row"))
    return normalize_revisions(latest.select(*identity, "_row.*"))


def latest_ok(snapshots: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The last good snapshot of every dataset."""
    keys = keys or ["source", "dataset"]
    others = [c for c in snapshots.columns if c not in keys]
    return snapshots.filter("status = 'ok'").groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct("retrieved_at", "snapshot_id")).alias("_row")).select(*keys, "_row.*")


def stage_rows(rows: DataFrame, root: str, snapshot_id: str) -> None:
    """Write a snapshot's observations into a folder of their own; a retry replaces it. Nothing reads them yet."""
    rows.drop("snapshot_id").write.mode("overwrite").parquet(f"{root}/observations/snapshot_id={snapshot_id}")


def append_snapshot(rows: DataFrame, root: str, snapshot_id: str, provenance: dict[str, str]) -> None:
    """Append a snapshot: its observations first, then the row that makes them visible.

    ``provenance`` is text by name; credentials in it are redacted. A snapshot whose row is written is never changed:
    a second append of its id raises. A job that dies in between leaves rows that no reader sees.
    """
    spark = rows.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/snapshots/snapshot_id={snapshot_id}/_SUCCESS")
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        raise ValueError(f"snapshot {snapshot_id} exists")
    stage_rows(rows, root, snapshot_id)
    entries = spark.createDataFrame([(k, v) for k, v in sorted(provenance.items())], "name string, value string")
    # a value is redacted as part of a name=value text, so that the names count
    safe = entries.select("name", F.regexp_replace(redact(F.concat_ws("=", "name", "value")), "^[^=]*=", "").alias("value"))
    safe.coalesce(1).write.mode("overwrite").parquet(f"{root}/snapshots/snapshot_id={snapshot_id}")


def committed(spark, root: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(snapshot_id, name, value) of the committed snapshots, and their observations of ``schema`` with snapshot_id."""
    snapshots = spark.read.schema("name string, value string, snapshot_id string").parquet(f"{root}/snapshots").select("snapshot_id", "name", "value")
    rows = spark.read.schema(f"{schema}, snapshot_id string").parquet(f"{root}/observations")
    return snapshots, rows.join(snapshots.select("snapshot_id").distinct(), "snapshot_id", "left_semi")
