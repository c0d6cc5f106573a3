"""Contracts as rule tables: named conditions over nested rows, all checked in one pass.

A rule is a name and a condition that holds for a good row; a condition that is NULL does not hold. ``violations`` gives a
row for each broken rule of each row, without a shuffle; ``counts`` gives every rule with the rows that break it, in one
aggregation with map-side combine; ``observed`` counts them while the rows go elsewhere, and ``enforced`` fails the job at
the first bad row.

Defined results: a missing field, map key or array breaks the rules that need it; NaN and infinities are not numbers; a
row that breaks several rules has a row for each; an empty table has no violations, and every rule with a count of 0.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tideline.operators.labels import STATES

HORIZONS = (1, 4, 13)
#: Tolerances of the contract.
EDGE, TOTAL, BOUND, ALIAS = 1e-9, 1e-5, 1.000001, 1e-8


class Rule(NamedTuple):
    name: str
    holds: Column


def _broken(rule: Rule) -> Column:
    return ~F.coalesce(rule.holds, F.lit(False))


def violations(rows: DataFrame, keys: list[str], rules: list[Rule]) -> DataFrame:
    """(keys, rule) of every broken rule."""
    names = F.filter(F.array(*[F.when(_broken(r), F.lit(r.name)) for r in rules]), lambda n: n.isNotNull())
    return rows.select(*keys, F.explode(names).alias("rule"))


def counts(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    """(rule, n_rows, n_violations) of every rule."""
    sums = rows.agg(F.count(F.lit(1)).alias("n_rows"), *[F.count(F.when(_broken(r), 1)).alias(f"_{k}") for k, r in enumerate(rules)])
    return sums.select(F.inline(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.col("n_rows"), F.col(f"_{k}").alias("n_violations")) for k, r in enumerate(rules)])))


def observed(rows: DataFrame, rules: list[Rule], name: str = "contract") -> tuple[DataFrame, Observation]:
    """``rows`` and an observation that holds the count of each rule once they have been written."""
    watch = Observation(name)
    return rows.observe(watch, *[F.count(F.when(_broken(r), 1)).alias(r.name) for r in rules]), watch


def enforced(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    """``rows``, in a job that fails with the names of the broken rules at a row that breaks any."""
    names = F.array_join(F.filter(F.array(*[F.when(_broken(r), F.lit(r.name)) for r in rules]), lambda n: n.isNotNull()), ", ")
    return rows.filter(F.when(names == "", F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("contract: "), names)).cast("boolean")))


def finite(x: Column, low: float | None = None, high: float | None = None) -> Column:
    """A number within the bounds."""
    known = x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf")))
    return known & (F.lit(True) if low is None else x >= low) & (F.lit(True) if high is None else x <= high)


def strict_boolean(x: Column) -> Column:
    """True where the value is a boolean, or a whole number that is 0 or 1; text and fractions never are."""
    whole = F.typeof(x).isin("tinyint", "smallint", "int", "bigint")
    return x.isNotNull() & ((F.typeof(x) == "boolean") | (whole & F.coalesce(x.try_cast("bigint").isin(0, 1), F.lit(False))))


def exact_keys(of: Column, keys: list[str]) -> Column:
    """The map has these keys and no others."""
    return F.array_sort(F.map_keys(of)) == F.array(*map(F.lit, sorted(keys)))


def probability_rules(name: str, of: Column) -> list[Rule]:
    """Rules of a map of state probabilities."""
    values = F.map_values(of)
    return [
        Rule(f"{name}.keys", exact_keys(of, list(STATES))),
        Rule(f"{name}.finite", F.forall(values, lambda p: finite(p))),
        Rule(f"{name}.range", F.forall(values, lambda p: finite(p, -EDGE, 1 + EDGE))),
        Rule(f"{name}.sum", F.abs(F.aggregate(values, F.lit(0.0), lambda a, p: a + p) - 1) <= TOTAL),
    ]


def risk_rules(horizon: int) -> list[Rule]:
    """Rules of the transition risk of one horizon: a struct (probability, target_end, model, threshold, fallback, fallback_reason)."""
    name, of = f"transition_risk.{horizon}w", F.element_at(F.col("transition_risk"), f"{horizon}w")
    return [
        Rule(f"{name}.probability", finite(of["probability"], 0, 1)),
        Rule(f"{name}.threshold", finite(of["threshold"], 0, 1)),
        Rule(f"{name}.model", of["model"] != ""),
        Rule(f"{name}.fallback", strict_boolean(of["fallback"])),
        Rule(f"{name}.fallback_reason", of["fallback_reason"].isNotNull()),
        Rule(f"{name}.target_end", F.datediff(of["target_end"], F.col("date")) == 7 * horizon),
    ]


def weekly_rules(scores: list[str]) -> list[Rule]:
    """The contract of published weeks: date, current and next_week (state, probabilities), transition_probability, scores
    and transition_risk by horizon. ``previous_date`` comes from ``with_previous``."""
    current, later, risk = F.col("current"), F.col("next_week"), F.col("transition_risk")
    first = F.element_at(risk, "1w")
    stay = F.element_at(later["probabilities"], current["state"])
    rules = [
        Rule("date.increasing", F.col("date").isNotNull() & (F.col("previous_date").isNull() | (F.col("date") > F.col("previous_date")))),
        Rule("current.state", current["state"].isin(*STATES)),
        *probability_rules("current.probabilities", current["probabilities"]),
        Rule("next_week.state", later["state"].isin(*STATES)),
        *probability_rules("next_week.probabilities", later["probabilities"]),
        Rule("transition_probability", finite(F.col("transition_probability"), 0, 1)),
        *[Rule(f"scores.{s}", finite(F.element_at(F.col("scores"), s), -BOUND, BOUND)) for s in scores],
        Rule("transition_risk.keys", exact_keys(risk, [f"{h}w" for h in HORIZONS])),
        *[r for h in HORIZONS for r in risk_rules(h)],
        Rule("alias.transition_probability", F.abs(F.col("transition_probability") - first["probability"]) <= ALIAS),
        Rule("alias.departure", F.abs(first["probability"] - (1 - stay)) <= ALIAS),
        Rule("alias.next_week_date", later["date"] == first["target_end"]),
    ]
    return rules


def with_previous(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``rows`` with previous_date: the date of the row before it in ``order``, by which rows were published."""
    return rows.withColumn("previous_date", F.lag("date").over(Window.partitionBy(*keys).orderBy(*order)))
