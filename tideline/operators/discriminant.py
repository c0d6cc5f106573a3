"""Shrinkage linear discriminant, walked forward by cumulative moments.

Every class of next states has a mean and a covariance that is shrunk on its own, in units of the class's deviations, by
the Ledoit-Wolf intensity; the covariances are pooled by the class shares. All of this follows from sums over the training
rows: counts, sums, products, and products of squares for the intensity. So a series is cut into blocks of weeks, sums of
blocks are added up to prefixes by a window, and a task that holds one block and its prefix solves one small system for
each origin, without going over earlier rows again. Tasks grow with the weeks, not with the series alone.

An origin learns from the pairs (features, next state) of rows before the purge of ``gap`` weeks.

Defined results: rows without a known state are left out; rows with a missing feature are not learned from, and an origin
with one gets the smoothed shares of the classes with ``fallback`` true, as does an origin with fewer than two classes in
training; a feature that does not vary in a class has deviation 1 there; empty tables give empty results; other columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators.labels import STATES

BLOCK = 52
MODEL = "shrinkage_lda"


class Moments:
    """Sums over the rows of one class: n, x, x y, x^2 y and x^2 y^2 for all pairs of features."""

    def __init__(self, width: int, flat: np.ndarray | None = None):
        self.width = width
        self.flat = np.zeros(self.size(width)) if flat is None else np.array(flat, dtype=float)

    @staticmethod
    def size(width: int) -> int:
        return 1 + width + 3 * width * width

    def add(self, x: np.ndarray) -> None:
        s = x * x
        self.flat += np.concatenate([[1.0], x, np.outer(x, x).ravel(), np.outer(s, x).ravel(), np.outer(s, s).ravel()])

    def parts(self) -> tuple[float, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The count and the means of x, x y, x^2 y and x^2 y^2."""
        w, n = self.width, self.flat[0]
        square = self.flat[1 + w :].reshape(3, w, w) / n
        return n, self.flat[1 : 1 + w] / n, *square

    def shrunk(self) -> tuple[np.ndarray, np.ndarray, float]:
        """Mean, shrunk covariance and the intensity of the shrinkage."""
        n, m, xy, ssy, ss = self.parts()
        cov = xy - np.outer(m, m)
        scale = np.sqrt(np.clip(np.diag(cov), 0, None))
        scale[scale < 1e-9] = 1.0
        unit, s = np.outer(scale, scale), np.diag(xy)
        r = cov / unit
        # the mean of (x - mx)^2 (y - my)^2 from the raw moments
        fourth = ss - 2 * ssy * m + np.outer(s, m * m) - 2 * (ssy * m).T + 4 * np.outer(m, m) * xy + np.outer(m * m, s) - 3 * np.outer(m * m, m * m)
        p, trace, delta = self.width, np.trace(r), (r * r).sum()
        mu = trace / p
        beta = ((fourth / unit**2).sum() - delta) / (p * n)
        spread = (delta - 2 * mu * trace + p * mu * mu) / p
        beta = min(beta, spread)
        intensity = 0.0 if beta <= 0 or spread <= 0 else beta / spread
        return m, ((1 - intensity) * r + intensity * mu * np.eye(p)) * unit, intensity


def solve(classes: list[Moments]) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (classes x features) and intercepts of the classes that have rows; minus infinity for the others."""
    width = classes[0].width
    total = sum(c.flat[0] for c in classes)
    coefficients, intercepts = np.zeros((len(classes), width)), np.full(len(classes), -np.inf)
    means, pooled = {}, np.zeros((width, width))
    for k, c in enumerate(classes):
        if c.flat[0]:
            means[k], cov, _ = c.shrunk()
            pooled += c.flat[0] / total * cov
    for k, m in means.items():
        coefficients[k] = np.linalg.lstsq(pooled, m, rcond=None)[0]
        intercepts[k] = np.log(classes[k].flat[0] / total) - m @ coefficients[k] / 2
    return coefficients, intercepts


def _softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max())
    return e / e.sum()


def walk_forward(frame: DataFrame, features: list[str], min_train: int, gap: int = 1, block: int = BLOCK) -> DataFrame:
    """Next-state forecasts at every origin of (series_id, week, state, features): series_id, origin, target_week, pos,
    current_state, actual, train_size, model, p_<state>, fallback."""
    width, code = len(features), {s: k for k, s in enumerate(STATES)}
    order = Window.partitionBy("series_id").orderBy("week")
    rows = frame.select("series_id", "week", "state", F.array(*[F.col(c).cast("double") for c in features]).alias("x")).filter(F.col("state").isin(*STATES))
    rows = rows.withColumns({"pos": F.row_number().over(order).cast("long") - 1, "actual": F.lead("state").over(order), "target_week": F.lead("week").over(order)})
    rows = rows.filter("actual IS NOT NULL")
    # a row is learned from by origins behind pos + gap, and is an origin itself
    trained = rows.withColumns({"block": F.expr(f"(pos + {gap}) div {block}"), "origin": F.lit(False)})
    asked = rows.filter(F.col("pos") >= min_train + gap).withColumns({"block": F.expr(f"pos div {block}"), "origin": F.lit(True)})

    def summed(part: pd.DataFrame) -> pd.DataFrame:
        own = [Moments(width) for _ in STATES]
        for x, actual in zip(part["x"], part["actual"], strict=True):
            x = np.array(x, dtype=float)
            if np.isfinite(x).all():
                own[code[actual]].add(x)
        return pd.DataFrame({"series_id": [part["series_id"].iloc[0]], "block": [part["block"].iloc[0]], "moments": [np.concatenate([m.flat for m in own]).tolist()]})

    sums = trained.select("series_id", "block", "x", "actual").groupBy("series_id", "block").applyInPandas(summed, "series_id string, block long, moments array<double>")
    cells = sums.select("series_id", "block", F.posexplode("moments").alias("at", "v"))
    upto = F.sum("v").over(Window.partitionBy("series_id", "at").orderBy("block"))
    prefixes = cells.withColumn("v", upto).groupBy("series_id", (F.col("block") + 1).alias("block")).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda c: c["v"]).alias("moments"))

    def forecasts(part: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        flat = before["moments"].iloc[0] if len(before) else np.zeros(len(STATES) * Moments.size(width))
        own = [Moments(width, f) for f in np.array(flat, dtype=float).reshape(len(STATES), -1)]
        learned = part[~part["origin"]].sort_values("pos")
        queue = list(zip(learned["pos"] + gap, learned["x"], learned["actual"], strict=True))
        out, at = [], 0
        for r in part[part["origin"]].sort_values("pos").itertuples():
            while at < len(queue) and queue[at][0] < r.pos:
                x = np.array(queue[at][1], dtype=float)
                if np.isfinite(x).all():
                    own[code[queue[at][2]]].add(x)
                at += 1
            x, counts = np.array(r.x, dtype=float), np.array([m.flat[0] for m in own])
            fell = not np.isfinite(x).all() or (counts > 0).sum() < 2
            if fell:
                p = (counts + 1) / (counts.sum() + len(STATES))
            else:
                coefficients, intercepts = solve(own)
                p = np.clip(_softmax(coefficients @ x + intercepts), 1e-9, 1)
                p = p / p.sum()
            out.append((r.series_id, r.week, r.target_week, r.pos, r.state, r.actual, int(counts.sum()), MODEL, *p, fell))
        return pd.DataFrame(out, columns=names)

    schema = "series_id string, origin date, target_week date, pos long, current_state string, actual string, train_size long, model string, "
    schema += ", ".join(f"p_{s} double" for s in STATES) + ", fallback boolean"
    names = [c.split()[0] for c in schema.split(", ")]
    both = trained.unionByName(asked).groupBy("series_id", "block")
    return both.cogroup(prefixes.groupBy("series_id", "block")).applyInPandas(forecasts, schema)
