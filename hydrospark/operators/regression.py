"""Least squares by normal equations: one aggregate of second moments over the
whole table, solved on the driver (features x features numbers)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class LinearFit:
    features: list[str]
    coefficients: list[float]
    intercept: float

    def predict(self) -> Column:
        out = F.lit(self.intercept)
        for name, c in zip(self.features, self.coefficients):
            out = out + F.col(name) * F.lit(c)
        return out


def linear_regression(df: DataFrame, features: list[str], label: str) -> LinearFit:
    """Ordinary least squares with an intercept. Features should be scaled (the
    moments are not shifted); of collinear ones the solution with the smallest
    norm is taken. Rows with a null feature or label do not count; no rows give
    zeros."""
    names = [*features, label]
    d = df.dropna(subset=names).select(*[F.col(c).cast("double").alias(c) for c in names])
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    row = d.agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"s{i}") for i, c in enumerate(names)],
                *[F.sum(F.col(names[i]) * F.col(names[j])).alias(f"m{i}_{j}") for i, j in pairs]).first()
    n, k = row["n"], len(features)
    if not n:
        return LinearFit(list(features), [0.0] * k, 0.0)
    mean = np.array([row[f"s{i}"] for i in range(k + 1)]) / n
    moments = np.zeros((k + 1, k + 1))
    for i, j in pairs:
        moments[i, j] = moments[j, i] = row[f"m{i}_{j}"] - n * mean[i] * mean[j]
    coef = np.linalg.pinv(moments[:k, :k], rcond=1e-12, hermitian=True) @ moments[:k, k]
    return LinearFit(list(features), coef.tolist(), float(mean[k] - mean[:k] @ coef))
