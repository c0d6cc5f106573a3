"""Names, required series and projections, with DuckDB SQL for each."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.functions.numeric import rounded
from tideline.operators import features, projection
from tideline.plans.feature_queries import r6, sql, z
from tideline.plans.registry import register
from tideline.session import read_table
from tideline.sources.panel import order_panel

_FIELDS = ["adjusted_close", "open", "close", "volume"]
_SERIES_SQL = (
    "s AS (SELECT 'market' AS source, n_name || '.' || f AS series_id FROM nation, (VALUES ('adjusted_close'), ('open'), ('close'), ('volume')) v(f) "
    "UNION ALL SELECT 'macro', r_name FROM region)"
)


def _required(spark, sf_dir):
    symbols = read_table(spark, sf_dir, "nation").select(F.col("n_name").alias("symbol"))
    macro = read_table(spark, sf_dir, "region").select(F.col("r_name").alias("id"))
    return projection.required_series(symbols, _FIELDS, macro, "market", "macro")


@register("p04_required_series", f"WITH {_SERIES_SQL} SELECT * FROM s", dates=())
def p04(spark, sf_dir):
    return _required(spark, sf_dir)


@register(
    "p03_column_names",
    f"""WITH {_SERIES_SQL} SELECT source, series_id, CASE WHEN source = 'macro' THEN lower(series_id)
 WHEN series_id LIKE '%.adjusted_close' THEN lower(split_part(series_id, '.', 1)) || '_close'
 WHEN series_id LIKE '%.volume' THEN lower(replace(series_id, '.', '_'))
 ELSE lower(split_part(series_id, '.', 1)) || '_raw_' || split_part(series_id, '.', 2) END AS column_name FROM s""",
    dates=(),
)
def p03(spark, sf_dir):
    return _required(spark, sf_dir).withColumn("column_name", projection.column_name(F.col("source"), F.col("series_id"), "market"))


@register("p02_select_features", sql(f" SELECT series_id, week, {r6(z('price', 52), 'z_52w')} FROM panel"))
def p02(spark, sf_dir):
    """Keys and z-scores; an all-NULL column that matches is dropped, and columns that match no pattern are."""
    wide = features.macro_z(order_panel(spark, sf_dir)).withColumn("z_never", F.lit(None).cast("double"))
    return rounded(projection.select_columns(wide, ["series_id", "week"], [r"^z_", r"__missing$"]))
