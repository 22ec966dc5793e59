"""The few vectorised Python helpers: they run on rows already reduced to one per group."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType


def min_norm_solve(gram: np.ndarray, rhs: np.ndarray) -> np.ndarray:
    """Minimum-norm solution of symmetric normal equations, collinear columns allowed."""
    return np.linalg.pinv(gram, rcond=1e-10, hermitian=True) @ rhs


def standardised_ols(mean: np.ndarray, my: float, cov: np.ndarray, cxy: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Coefficients on standardised columns, column means and population sds, and the intercept, from centred moments."""
    sd = np.sqrt(np.maximum(np.diag(cov), 0.0))
    flat = sd <= 1e-12 * np.maximum(np.abs(mean), 1.0)
    scale = np.where(flat, 1.0, sd)
    gram = cov / np.outer(scale, scale)
    gram[flat, :] = 0.0
    gram[:, flat] = 0.0
    rhs = np.where(flat, 0.0, cxy / scale)
    return min_norm_solve(gram, rhs), mean, scale, my


OLS_TYPE = StructType([
    StructField("coef", ArrayType(DoubleType())), StructField("mean", ArrayType(DoubleType())),
    StructField("scale", ArrayType(DoubleType())), StructField("intercept", DoubleType()),
])


@F.pandas_udf(OLS_TYPE)
def ols_from_moments(mean: pd.Series, my: pd.Series, upper: pd.Series, cxy: pd.Series) -> pd.DataFrame:
    """One regression per row of centred moments; `upper` is the row-wise upper triangle of the covariances."""
    rows = []
    for a, b, u, c in zip(mean, my, upper, cxy):
        k = len(a)
        m = np.zeros((k, k))
        m[np.triu_indices(k)] = u
        m = m + m.T - np.diag(np.diag(m))
        coef, mean_, scale, icpt = standardised_ols(np.asarray(a, float), float(b), m, np.asarray(c, float))
        rows.append((coef.tolist(), mean_.tolist(), scale.tolist(), float(icpt)))
    return pd.DataFrame(rows, columns=["coef", "mean", "scale", "intercept"])
