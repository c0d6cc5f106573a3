"""Planted violations of the contract, one by one."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tideline.operators import contract

RISK = "struct<probability:double,target_end:date,model:string,threshold:double,fallback:boolean,fallback_reason:string>"
ESTIMATE = "state:string,probabilities:map<string,double>"
SCHEMA = f"k int, n int, date date, current struct<{ESTIMATE}>, next_week struct<date:date,{ESTIMATE}>, transition_probability double, scores map<string,double>, transition_risk map<string,{RISK}>"
DAY = dt.date(2024, 1, 5)
STATES = ("risk_on", "transition", "risk_off")


def week(k, date=DAY, **changes):
    after = lambda h: date + dt.timedelta(7 * h)
    good = {
        "k": k, "n": 0, "date": date, "current": ("risk_on", dict(zip(STATES, (1.0, 0.0, 0.0), strict=True))),
        "next_week": (after(1), "risk_on", dict(zip(STATES, (0.7, 0.2, 0.1), strict=True))), "transition_probability": 0.3, "scores": {"trend": 0.5, "stress": -1.0},
        "transition_risk": {f"{h}w": (0.3, after(h), "markov_hazard", 0.5, False, "") for h in (1, 4, 13)},
    }
    return tuple((good | changes).values())


def risk(h, **changes):
    names = ("probability", "target_end", "model", "threshold", "fallback", "fallback_reason")
    out = {f"{x}w": dict(zip(names, (0.3, DAY + dt.timedelta(7 * x), "m", 0.5, False, ""), strict=True)) for x in (1, 4, 13)}
    out[f"{h}w"] |= changes
    return {k: tuple(v.values()) for k, v in out.items()}


CASES = [
    ({}, set()),
    ({"current": ("risky", {"risk_on": 1.0, "transition": 0.0, "risk_off": 0.0})}, {"current.state", "alias.departure"}),
    ({"current": ("risk_on", {"risk_on": 1.0, "transition": 0.0})}, {"current.probabilities.keys"}),
    ({"current": ("risk_on", {"risk_on": 1.1, "transition": -0.1, "risk_off": 0.0})}, {"current.probabilities.range"}),
    ({"current": ("risk_on", {"risk_on": 0.9, "transition": 0.0, "risk_off": 0.0})}, {"current.probabilities.sum"}),
    ({"current": None}, {"current.state", "alias.departure", *(f"current.probabilities.{x}" for x in ("keys", "finite", "range", "sum"))}),
    ({"next_week": (DAY + dt.timedelta(7), "risk_on", {"risk_on": float("nan"), "transition": 0.2, "risk_off": 0.1})}, {*(f"next_week.probabilities.{x}" for x in ("finite", "range", "sum")), "alias.departure"}),
    ({"next_week": (DAY + dt.timedelta(8), "risk_on", {"risk_on": 0.7, "transition": 0.2, "risk_off": 0.1})}, {"alias.next_week_date"}),
    ({"transition_probability": 1.5}, {"transition_probability", "alias.transition_probability"}),
    ({"transition_probability": 0.30001}, {"alias.transition_probability"}),
    ({"scores": {"trend": 1.1}}, {"scores.trend", "scores.stress"}),
    ({"transition_risk": {k: v for k, v in risk(1).items() if k != "4w"}}, {"transition_risk.keys", *(f"transition_risk.4w.{x}" for x in ("probability", "threshold", "model", "fallback", "fallback_reason", "target_end"))}),
    ({"transition_risk": risk(4, probability=float("inf"))}, {"transition_risk.4w.probability"}),
    ({"transition_risk": risk(13, threshold=-0.1, model="")}, {"transition_risk.13w.threshold", "transition_risk.13w.model"}),
    ({"transition_risk": risk(13, fallback=None, fallback_reason=None, target_end=DAY)}, {"transition_risk.13w.fallback", "transition_risk.13w.fallback_reason", "transition_risk.13w.target_end"}),
    ({"transition_risk": risk(1, probability=0.4)}, {"alias.transition_probability", "alias.departure"}),
]


@pytest.fixture
def rules():
    return contract.weekly_rules(["trend", "stress"])


def test_planted_violations(spark, rules):
    frame = contract.with_previous(spark.createDataFrame([week(k, **c) for k, (c, _) in enumerate(CASES)], SCHEMA), ["k"], ["n"])
    found = {k: set() for k in range(len(CASES))}
    for r in contract.violations(frame, ["k"], rules).collect():
        found[r.k].add(r.rule)
    assert found == {k: want for k, (_, want) in enumerate(CASES)}
    totals = {r.rule: r.n_violations for r in contract.counts(frame, rules).collect()}
    assert totals.keys() == {r.name for r in rules} and totals == {r.name: sum(r.name in want for _, want in CASES) for r in rules}
    watched, seen = contract.observed(frame, rules)
    watched.write.format("noop").mode("overwrite").save()
    assert seen.get == totals
    with pytest.raises(Exception, match="scores.trend, scores.stress"):
        contract.enforced(frame.filter("k = 10"), rules).collect()
    assert contract.enforced(frame.filter("k = 0"), rules).count() == 1
    assert {r.n_violations for r in contract.counts(frame.limit(0), rules).collect()} == {0}


def test_dates_must_increase(spark, rules):
    rows = [week(1, DAY + dt.timedelta(7 * d), n=n) for n, d in enumerate((0, 1, 1, 3, 2))]
    frame = contract.with_previous(spark.createDataFrame(rows, SCHEMA), ["k"], ["n"])
    assert sorted(r.n for r in contract.violations(frame, ["n"], rules).filter("rule = 'date.increasing'").collect()) == [2, 4]


def test_strict_booleans(spark):
    frame = spark.sql("SELECT true AS a, 1 AS b, 0L AS c, 2 AS d, 1.0D AS e, 'true' AS f, CAST(NULL AS BOOLEAN) AS g, CAST(1 AS TINYINT) AS h")
    got = frame.select(*[contract.strict_boolean(F.col(c)).alias(c) for c in frame.columns]).first().asDict()
    assert got == dict(a=True, b=True, c=True, d=False, e=False, f=False, g=False, h=True)
