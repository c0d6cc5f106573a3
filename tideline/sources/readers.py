"""Strict readers of JSON and CSV files, and of whole vintages.

A file is read with an explicit schema. A row that does not fit it, by its form or by the type of any field, is kept with
its text and its file instead of the values, so nothing is lost or guessed; the two kinds come from one scan.

Defined results: blank lines are no rows; an empty file gives no rows; a missing JSON field is NULL, and a rejected row if
the field is ``required``; fields beyond the schema are ignored in JSON and reject the row in CSV; a CSV file whose header differs from
the schema rejects its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tideline.operators.contract import Rule, violations

CORRUPT = "_corrupt_record"


def _all_read(rows: DataFrame, columns: list[str]) -> Column:
    """Always true, but of every field: Spark does not parse, and so does not judge, fields that a query leaves out."""
    if any("map<" in t for c, t in rows.dtypes if c in columns):
        return F.length(F.to_json(F.struct(*columns))) >= 0
    return F.xxhash64(*columns) >= F.lit(-(2**63))


def _strict(rows: DataFrame, columns: list[str], required: list[str], refused: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Good rows, and (file, record, reason) of the others and of all rows of the ``refused`` files."""
    named = rows.select(*columns, CORRUPT, F.col("_metadata.file_path").alias("file")).withColumn("_refused", F.lit(False))
    if refused is not None:
        named = named.drop("_refused").join(refused.withColumn("_refused", F.lit(True)), "file", "left").withColumn("_refused", F.coalesce("_refused", F.lit(False)))
    lacking = F.lit(False)
    for c in required:
        lacking = lacking | F.col(c).isNull()
    reason = F.when(F.col("_refused"), "header differs").when(F.col(CORRUPT).isNotNull(), "malformed or mistyped").when(lacking, "required field missing")
    judged = named.withColumn("reason", reason).filter(_all_read(rows, columns))
    record = F.coalesce(F.col(CORRUPT), F.to_json(F.struct(*columns)))
    return judged.filter("reason IS NULL").select(columns), judged.filter("reason IS NOT NULL").select("file", record.alias("record"), "reason")


def _with_corrupt(spark: SparkSession, schema: str) -> tuple[StructType, list[str]]:
    fields = spark.createDataFrame([], schema).schema
    return StructType([*fields.fields]).add(CORRUPT, "string"), fields.names


def read_json(spark: SparkSession, path: str, schema: str, required: list[str] = [], whole_file: bool = False) -> tuple[DataFrame, DataFrame]:  # noqa: B006
    """Good rows, and (file, record, reason) of the rejected ones, of JSON lines (or of one document a file)."""
    full, columns = _with_corrupt(spark, schema)
    if "tinyint" in full.simpleString():
        raise ValueError("tinyint is not strict: Spark's JSON parser reads 128 to 255 into it as negative numbers")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "multiLine": str(whole_file).lower(), "allowNonNumericNumbers": "false", "primitivesAsString": "false"}
    return _strict(spark.read.schema(full).options(**options).json(path), columns, required)


def read_csv(spark: SparkSession, path: str, schema: str, required: list[str] = [], time_format: str = "yyyy-MM-dd'T'HH:mm:ssXXX") -> tuple[DataFrame, DataFrame]:  # noqa: B006
    """Good rows, and (file, record, reason) of the rejected ones, of CSV files with a header. Times carry their zone."""
    full, columns = _with_corrupt(spark, schema)
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "header": "true", "escape": '"', "timestampFormat": time_format, "dateFormat": "yyyy-MM-dd", "multiLine": "true"}
    rows = spark.read.schema(full).options(**options).csv(path)
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value", F.monotonically_increasing_id().alias("at"))
    headers = lines.filter("block = 0").groupBy("file").agg(F.min_by("value", "at").alias("header"))
    names = F.regexp_replace("header", "[\ufeff\" \r]", "")
    return _strict(rows, columns, required, headers.filter(names != ",".join(columns)).select("file"))


def read_config(spark: SparkSession, path: str, schema: str, rules: list[Rule]) -> DataFrame:
    """One JSON document that keeps all rules, as a row; raises ValueError with what it breaks. A config is small."""
    good, bad = read_json(spark, path, schema, whole_file=True)
    problems = [r["reason"] for r in bad.limit(5).collect()] + [r["rule"] for r in violations(good, [], rules).limit(100).collect()]
    rows = len(good.limit(2).collect())
    if problems or rows != 1:
        raise ValueError(f"config {path}: " + (", ".join(problems) or f"{rows} documents"))
    return good


#: How the values of a longer period follow from those of the shorter ones.
METHODS = {"eop": lambda v: F.max_by(v, F.when(v.isNotNull(), F.col("period"))), "avg": F.avg, "sum": F.sum}


def full_vintages(
    wide: DataFrame, vintages: list[str], period: str = "period", series: str = "series_id", cells: str = "cells", frequency: str | None = None, method: str = "eop"
) -> tuple[DataFrame, DataFrame]:
    """Revisions of whole vintages, and the rejected cells.

    ``wide`` has a row for each series and period with a map of SERIES_YYYYMMDD cells (text); every requested vintage must be
    there, and "." or blanks is a missing value. Within a vintage the periods are aggregated to ``frequency`` (a unit of
    date_trunc) if one is named. A vintage repeats all values, so only what differs from the vintage before is a revision;
    a value that goes missing is a tombstone, and what was always missing is none. Rejected are cells that are absent
    (reason absent) or no number (reason mistyped): (series_id, period, vintage_date, raw, reason).
    """
    asked = F.explode(F.array(*[F.lit(v).cast("date") for v in sorted(set(vintages))])).alias("vintage_date")
    rows = wide.select(F.col(series).alias("series_id"), F.col(period).alias("period"), F.col(cells).alias("cells"), asked)
    name = F.concat_ws("_", "series_id", F.date_format("vintage_date", "yyyyMMdd"))
    raw = F.element_at("cells", name)
    blank = F.trim(raw).isin(".", "")
    number = F.when(~blank, raw.try_cast("double"))
    found = rows.select("series_id", "period", "vintage_date", raw.alias("raw"), F.array_contains(F.map_keys("cells"), name).alias("there"), number.alias("value"), F.coalesce(blank, F.lit(True)).alias("blank"))
    absent, mistyped = ~F.col("there"), F.col("there") & ~F.col("blank") & (F.col("value").isNull() | F.isnan("value") | (F.abs("value") == float("inf")))
    rejected = found.filter(absent | mistyped).select("series_id", "period", "vintage_date", "raw", F.when(absent, "absent").otherwise("mistyped").alias("reason"))
    good = found.filter(~absent & ~mistyped).select("series_id", "period", "vintage_date", "value")
    if frequency:
        grouped = F.to_date(F.date_trunc(frequency, "period"))
        good = good.groupBy("series_id", grouped.alias("_to"), "vintage_date").agg(METHODS[method](F.col("value")).alias("value")).withColumnRenamed("_to", "period")
    order = Window.partitionBy("series_id", "period").orderBy("vintage_date")
    before = F.lag("value").over(order)
    changed = good.withColumn("_new", ~F.col("value").eqNullSafe(before)).filter("_new")
    numbered = changed.withColumn("revision_seq", (F.row_number().over(order) - 1).cast("int"))
    return numbered.select("series_id", F.col("period").alias("observed_period_end"), "vintage_date", "value", "revision_seq"), rejected
