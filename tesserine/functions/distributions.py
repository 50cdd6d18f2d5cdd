"""Tail probabilities that Spark SQL lacks, as small vectorised helpers."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - beta_inc(b, a, 1.0 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            c = 1.0 + num / c
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return front * h


def t_two_sided(t: float, dof: float) -> float:
    return beta_inc(dof / 2.0, 0.5, dof / (dof + t * t))


def t_quantile(p: float, dof: float) -> float:
    """Inverse Student-t by bisection on the tail probability (p > 0.5)."""
    low, high = 0.0, 1e6
    for _ in range(200):
        mid = 0.5 * (low + high)
        if 1.0 - 0.5 * t_two_sided(mid, dof) < p:
            low = mid
        else:
            high = mid
    return 0.5 * (low + high)


def f_upper(f: float, d1: float, d2: float) -> float:
    return beta_inc(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f))


def chi2_upper_one(x: float) -> float:
    return math.erfc(math.sqrt(max(x, 0.0) / 2.0))


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def _vector(fn):
    def run(*cols: pd.Series) -> pd.Series:
        return pd.Series([
            fn(*map(float, row)) if all(v is not None and np.isfinite(v) for v in row) else None for row in zip(*cols)
        ], dtype="float64")
    return run


@F.pandas_udf(T.DoubleType())
def spearman_p(rho: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided asymptotic p of a rank correlation."""
    def one(r: float, m: float) -> float:
        if abs(r) >= 1.0:
            return 0.0
        return t_two_sided(r * math.sqrt((m - 2) / (1 - r * r)), m - 2)
    return _vector(one)(rho, n)


@F.pandas_udf(T.DoubleType())
def f_p(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return _vector(f_upper)(f, d1, d2)


@F.pandas_udf(T.DoubleType())
def normal_p(z: pd.Series) -> pd.Series:
    return _vector(normal_two_sided)(z)


@F.pandas_udf(T.DoubleType())
def chi2_one_p(x: pd.Series) -> pd.Series:
    return _vector(chi2_upper_one)(x)
