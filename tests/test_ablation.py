"""Ablation scores by hand."""

import datetime as dt
import math

import pytest

from tideline.operators import ablation

ROW = "variant string, origin date, target_week date, evaluation_split string, current_state string, actual string, p_risk_on double, p_transition double, p_risk_off double, fallback boolean"


def row(variant, k, p, split="selection", actual="risk_on", fell=False):
    day = dt.date(2020, 1, 3) + dt.timedelta(7 * k)
    rest = (1 - p) / 2
    return (variant, day, day + dt.timedelta(7), split, "risk_on", actual, p, rest, rest, fell)


def board(spark, rows, variants):
    return {(r.variant, r.evaluation_split): r for r in ablation.leaderboard(spark.createDataFrame(rows, ROW), [], "base", variants).collect()}


def test_paired_differences_and_ranks(spark):
    ps = {"base": (0.5, 0.6), "good": (0.8, 0.6), "fell": (0.9, 0.9), "bad": (0.3, 0.3)}
    rows = [row(v, k, p, fell=v == "fell" and k == 0) for v, own in ps.items() for k, p in enumerate(own)]
    rows += [row(v, 9, 0.9 if v == "bad" else 0.2, "holdout") for v in ps]
    got = board(spark, rows, 4)
    assert {v: got[v, "selection"].selection_rank for v in ps} == {"good": 1, "base": 2, "bad": 3, "fell": 4}
    assert all(got[v, "holdout"].selection_rank == got[v, "selection"].selection_rank for v in ps)
    want = (math.log(0.5 / 0.8) + 0) / 2
    assert math.isclose(got["good", "selection"].log_loss_delta, want, abs_tol=1e-9) and got["base", "selection"].brier_delta == 0
    brier = lambda p: (1 - p) ** 2 + 2 * ((1 - p) / 2) ** 2
    assert math.isclose(got["good", "selection"].brier_delta, (brier(0.8) - brier(0.5)) / 2, abs_tol=1e-9)
    assert [v for v in ps if got[v, "selection"].selection_winner] == ["good"]


def test_holdout_rows_change_no_rank(spark):
    rows = [row(v, k, p) for v, p in (("base", 0.5), ("x", 0.6), ("y", 0.55)) for k in range(3)]
    later = lambda p: [row(v, 9, p[v], "holdout") for v in ("base", "x", "y")]
    ranks = lambda found: {k: (r.selection_rank, r.selection_winner) for k, r in found.items()}
    assert ranks(board(spark, rows + later({"base": 0.1, "x": 0.1, "y": 0.9}), 3)) == ranks(board(spark, rows + later({"base": 0.9, "x": 0.1, "y": 0.1}), 3))


def test_without_an_eligible_variant_the_anchor_leads(spark):
    rows = [row(v, 0, p, fell=True) for v, p in (("base", 0.2), ("a", 0.9), ("b", 0.8))]
    assert {v: r.selection_rank for (v, _), r in board(spark, rows, 3).items()} == {"base": 1, "a": 2, "b": 3}
    assert board(spark, [], 3) == {}


def test_unpaired_origins_are_refused(spark):
    rows = [row("base", 0, 0.5), row("x", 0, 0.5), row("base", 1, 0.5)]
    with pytest.raises(Exception, match="do not share"):
        board(spark, rows, 2)
    frame = spark.createDataFrame([*rows, row("x", 1, 0.5, actual="risk_off")], ROW)
    assert ablation.unpaired(frame, [], 2).count() == 1
    assert ablation.unpaired(spark.createDataFrame(rows, ROW), [], 2).count() == 1


def test_variants():
    groups = {"a": ["x"], "b": ["y", "z"], "c": ["w"]}
    assert ablation.variants_of(groups, "a", ["a"], {"b": ["b"]}) == {"a": ["x"], "a_plus_b": ["x", "y", "z"], "all": ["x", "y", "z", "w"]}
    with pytest.raises(ValueError):
        ablation.variants_of({"a": ["x"], "b": ["x"]}, "a", ["a"], {})
