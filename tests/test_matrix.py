"""Composed feature tables against hand-written values, and that they look back only."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from tideline.operators import matrix

FIRST = dt.date(2020, 1, 3)
PANEL = "series_id string, week date, price double, volume double"


def panel(weeks=70, seed=4):
    draw, rows = random.Random(seed), []
    for s in ("one", "two", "three", "gold"):
        price = 100.0
        for k in range(weeks):
            price *= math.exp(draw.gauss(0, 0.03))
            rows.append((s, FIRST + dt.timedelta(7 * k), None if s == "two" and k % 17 == 5 else round(price, 4), float(draw.randrange(1000))))
    return rows


def by_key(df):
    return {(r.series_id, r.week): r.asDict() for r in df.collect()}


def test_matrix_has_all_parts_and_looks_back_only(spark):
    rows, at = panel(), FIRST + dt.timedelta(7 * 55)
    whole = by_key(matrix.weekly_matrix(spark.createDataFrame(rows, PANEL), "one", ("gold",)))
    before = by_key(matrix.weekly_matrix(spark.createDataFrame([r for r in rows if r[1] <= at], PANEL), "one", ("gold",)))
    assert len(whole) == len(rows) and len(before) == 4 * 56
    for k, row in before.items():
        for name, value in row.items():
            other = whole[k][name]
            assert value == other or value == pytest.approx(other, rel=1e-9, abs=1e-9), (k, name)
    price = {(r[0], r[1]): r[2] for r in rows}
    back = lambda s, n: math.log(price[s, at] / price[s, at - dt.timedelta(7 * n)])
    row = before["three", at]
    assert row["log_return_4w"] == pytest.approx(back("three", 4)) and row["relative_return_13w"] == pytest.approx(back("three", 13) - back("one", 13))
    assert before["one", at]["relative_return_13w"] is None and before["gold", at]["relative_return_4w"] is not None
    inside = [back(s, 4) for s in ("one", "two", "three")]
    assert all(before[s, at]["positive_share_4w"] == pytest.approx(sum(x > 0 for x in inside) / 3) for s in ("one", "gold"))
    assert {"rising_volume_share", "average_correlation_13w", "above_mean_share_26w", "dispersion", "breadth_change_4w", "price__missing", "volume_z_52w", "drawdown_52w", "downside_vol_4w"} <= row.keys()
    assert matrix.weekly_matrix(spark.createDataFrame([], PANEL), "one").count() == 0


STATES = [("risk_on", 2.0), ("risk_on", 1.5), ("transition", 0.4), ("risk_off", -1.0), ("risk_off", None)]


def states(spark):
    rows = [("a", FIRST + dt.timedelta(7 * k), s, v, 0.0, 1.0, 9 + k) for k, (s, v) in enumerate(STATES)]
    return spark.createDataFrame(rows, "series_id string, week date, state string, risk_score double, lower double, upper double, spare int")


def test_transition_features_by_hand(spark):
    out = matrix.transition_features(states(spark)).orderBy("week").collect()
    assert [r.duration for r in out] == [1, 2, 1, 1, 2] and [r.spare for r in out] == [9, 10, 11, 12, 13]
    assert [r.score_change_1w for r in out] == pytest.approx([None, -0.5, -1.1, -1.4, None])
    assert [r.state_distance for r in out] == pytest.approx([1.0, 0.5, 0.4, 1.0, None])
    assert [r.nearest_boundary for r in out] == pytest.approx([1.0, 0.5, 0.4, 1.0, None])


def test_columns_that_are_there_stay(spark):
    own = states(spark).withColumns({"duration": F.lit(7), "score_change_1w": F.lit(0.25)})
    kept, new = (matrix.transition_features(own, o).orderBy("week").collect() for o in (False, True))
    assert {r.duration for r in kept} == {7} and {r.score_change_1w for r in kept} == {0.25}
    assert [r.duration for r in new] == [1, 2, 1, 1, 2] and new[1].score_change_1w == pytest.approx(-0.5)
    assert [r.score_change_2w for r in kept] == [r.score_change_2w for r in new]
    bare = matrix.transition_features(states(spark).drop("lower", "upper"))
    assert "score_acceleration" in bare.columns and "to_lower" not in bare.columns
    assert matrix.transition_features(states(spark).drop("risk_score")).columns == [*states(spark).drop("risk_score").columns, "duration"]


def test_transition_features_refuse(spark):
    for bad in (states(spark).drop("lower"), states(spark).drop("state")):
        with pytest.raises(ValueError):
            matrix.transition_features(bad)
    for column, value in (("duration", F.lit(0)), ("duration", F.lit(1.5)), ("duration", F.lit(None).cast("int")), ("upper", F.lit(-1.0))):
        with pytest.raises(Exception, match="durations must|thresholds must"):
            matrix.transition_features(states(spark).withColumn(column, value)).collect()


def test_market_context_by_hand(spark):
    rows, at = panel(), FIRST + dt.timedelta(7 * 60 + 2)
    later = [r if r[1] <= at else (*r[:2], 1.0, 1.0) for r in rows]
    one, other = (matrix.market_context(spark.createDataFrame(x, PANEL), "one", ["three", "absent"], str(at)).collect() for x in (rows, later))
    assert one == other and len(one) == 1
    own = [r[2] for r in rows if r[0] == "one"][:61]
    returns = [math.log(b / a) for a, b in zip(own, own[1:], strict=False)][-13:]
    mean = sum(returns) / 13
    r = one[0]
    assert r.week == FIRST + dt.timedelta(7 * 60) and r.price == own[-1] and r.log_return_1w == pytest.approx(returns[-1])
    assert r.realized_vol_13w == pytest.approx(math.sqrt(sum((x - mean) ** 2 for x in returns) / 13 * 52))
    assert r.downside_vol_13w == pytest.approx(math.sqrt(sum(min(x, 0) ** 2 for x in returns) / 13 * 52))
    assert r.drawdown_52w == pytest.approx(own[-1] / max(own[-52:]) - 1)
    three = [x[2] for x in rows if x[0] == "three"][:61]
    assert r.relative_three == pytest.approx(math.log(three[-1] / three[-14]) - math.log(own[-1] / own[-14])) and r.relative_absent is None
    assert matrix.market_context(spark.createDataFrame(rows, PANEL), "absent", ["one"]).count() == 0
