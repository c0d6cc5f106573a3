"""A spline basis as a pyspark.ml transformer, fitted on quantiles of each component of a vector.

The basis of a component is B-splines of ``degree`` over ``knots`` quantile knots without the last one, as it follows from the
others; beyond the outer knots it goes on in straight lines. Fitting is one aggregation; transforming is column expressions.
Both stages are saved and loaded by their parameters.

Defined results: a component whose knots coincide gives zeros; NULL vectors give NULL; an empty table cannot be fitted.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACCURACY = 1_000_000


def knot_vector(base: list[float], degree: int) -> list[float]:
    """The knots with ``degree`` more on either side, as far apart as the outer ones."""
    left, right = base[1] - base[0], base[-1] - base[-2]
    return [*[base[0] - left * d for d in range(degree, 0, -1)], *base, *[base[-1] + right * d for d in range(1, degree + 1)]]


def basis(x, knots: list[float], degree: int, low: float, high: float, test) -> list:
    """The B-splines at ``x`` within [low, high], by their recursion; works on numbers and, with ``test``, on columns."""
    inside = [test(x, a, b, b == high) if a < high else x * 0.0 for a, b in zip(knots, knots[1:], strict=False)]
    own = inside
    for d in range(1, degree + 1):
        own = [_blend(x, knots[i], knots[i + d], own[i], 1) + _blend(x, knots[i + 1], knots[i + d + 1], own[i + 1], -1) for i in range(len(own) - 1)]
    return own


def _blend(x, a: float, b: float, value, side: int):
    if b == a:
        return value * 0.0
    return value * (x - a) / (b - a) if side == 1 else value * (b - x) / (b - a)


def _number(x: float, a: float, b: float, closed: bool) -> float:
    return float(a <= x < b or (closed and x == b))


def _column(x: Column, a: float, b: float, closed: bool) -> Column:
    return F.when((x >= a) & ((x <= b) if closed else (x < b)), 1.0).otherwise(0.0)


def slopes(knots: list[float], degree: int, at: float, low: float, high: float) -> list[float]:
    lower = basis(at, knots, degree - 1, low, high, _number)
    rise = lambda i: 0.0 if knots[i + degree] == knots[i] else degree * lower[i] / (knots[i + degree] - knots[i])
    return [rise(i) - rise(i + 1) for i in range(len(lower) - 1)]


class _Shape(HasInputCol, HasOutputCol):
    knots = Param(Params._dummy(), "knots", "quantile knots of a component, at least 2", TypeConverters.toInt)
    degree = Param(Params._dummy(), "degree", "degree of the splines, at least 1", TypeConverters.toInt)


class QuantileSplines(Estimator, _Shape, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, knots=3, degree=2):
        super().__init__()
        self._setDefault(knots=3, degree=2)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> QuantileSplinesModel:
        count = self.getOrDefault(self.knots)
        at = [k / (count - 1) for k in range(count)]
        cells = dataset.select(F.posexplode(vector_to_array(F.col(self.getInputCol()))).alias("component", "x"))
        found = cells.groupBy("component").agg(F.percentile_approx("x", at, ACCURACY).alias("q")).orderBy("component").collect()  # a row for each component
        places = [float(x) for row in found for x in row["q"]]
        model = QuantileSplinesModel(inputCol=self.getInputCol(), outputCol=self.getOutputCol(), knots=count, degree=self.getOrDefault(self.degree), places=places)
        return model._resetUid(self.uid)


class QuantileSplinesModel(Model, _Shape, DefaultParamsReadable, DefaultParamsWritable):
    places = Param(Params._dummy(), "places", "knots of all components, end to end", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, knots=None, degree=None, places=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        count, degree, places = (self.getOrDefault(p) for p in (self.knots, self.degree, self.places))
        values = vector_to_array(F.col(self.getInputCol()))
        out = []
        for k in range(len(places) // count):
            base = places[k * count : (k + 1) * count]
            low, high = base[0], base[-1]
            full, x = knot_vector(base, degree), values[k]
            near = F.greatest(F.least(x, F.lit(high)), F.lit(low))
            left, right = (slopes(full, degree, at, low, high) for at in (low, high))
            for i, own in enumerate(basis(near, full, degree, low, high, _column)[:-1]):
                beyond = F.when(x < low, (x - low) * left[i]).when(x > high, (x - high) * right[i]).otherwise(0.0)
                out.append((own + beyond) if high > low else F.lit(0.0))
        made = array_to_vector(F.array(*out))
        return dataset.withColumn(self.getOutputCol(), F.when(F.col(self.getInputCol()).isNotNull(), made))
