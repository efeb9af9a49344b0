"""L2 logistic regression by Newton's method on dense sums.

A fit is some eight passes over the rows, each of which adds one small matrix a task; it ends at the
optimum to rounding, so two fits of the same rows agree. The matrix has the width of the
design squared; `models.fit` leaves wide designs to the iterative solver of Spark ML.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

from cohortica.operators.survival import newton, tenure_sums

MAX_WIDTH = 1000


@dataclass(frozen=True)
class LinearFit:
    """Intercept and coefficients of standardised or one-hot ``features``."""

    intercept: float
    coefficients: np.ndarray

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``probability``, a vector of both classes, as Spark ML models do."""
        terms = F.zip_with(vector_to_array("features"), F.array(*[F.lit(float(c)) for c in self.coefficients]).cast("array<double>"),
                           lambda x, b: x * b)
        eta = F.aggregate(terms, F.lit(float(self.intercept)), lambda total, t: total + t)
        p = 1 / (1 + F.exp(-eta))
        return df.withColumn("probability", array_to_vector(F.array(1 - p, p)))


def fit_logistic(rows: DataFrame, label: str, ridge: float, weight: str | None = None, max_iter: int = 60,
                 tolerance: float = 1e-10) -> LinearFit:
    """Weighted mean log loss plus ``ridge / 2`` of the squared coefficients; the intercept is free.

    Rows of a single class have zero coefficients and a certain prediction.
    """
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    x = F.concat(F.array(F.lit(1.0)), vector_to_array("features"), F.array(w))
    data = rows.select(x.alias("x"), F.col(label).cast("double").alias("y"), F.lit(1).alias("stop")).persist()
    try:
        size, positives, n = data.agg(F.max(F.size("x")), F.sum("y"), F.count(F.lit(1))).first()
        if not n:
            raise ValueError("a logistic fit needs rows")
        d = size - 1
        if positives in (0, n):
            return LinearFit(float("inf") if positives else float("-inf"), np.zeros(d - 1))
        free = np.r_[0.0, np.full(d - 1, ridge)]

        def evaluate(beta: np.ndarray):
            def part(xw: np.ndarray, y: np.ndarray, _: int) -> np.ndarray:
                x, w = xw[:, :-1], xw[:, -1]
                eta = x @ beta
                p = 1 / (1 + np.exp(-np.clip(eta, -700, 700)))
                loss = np.log1p(np.exp(-np.abs(eta))) + np.maximum(eta, 0) - y * eta
                return np.concatenate([[w.sum(), w @ loss], (w * (p - y)) @ x, ((x * (w * p * (1 - p))[:, None]).T @ x).ravel()])

            sums = tenure_sums(data, part, np.add)[1]
            total = sums[0]
            grad = sums[2:2 + d] / total + free * beta
            hess = sums[2 + d:].reshape(d, d) / total + np.diag(free)
            return sums[1] / total + 0.5 * float(free @ beta**2), grad, np.linalg.solve(hess, grad)

        beta = newton(evaluate, np.zeros(d), max_iter, tolerance)
        return LinearFit(float(beta[0]), beta[1:])
    finally:
        data.unpersist()
