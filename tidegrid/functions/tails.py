"""Tail probabilities for small result tables (one row per test)."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F


def _gamma_tail(a: float, x: float) -> float:
    """Upper regularised incomplete gamma: series below a + 1, continued fraction above."""
    if x <= 0:
        return 1.0
    head = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        for n in range(1, 500):
            term *= x / (a + n)
            total += term
            if term < total * 1e-15:
                break
        return 1.0 - head * total
    b, f = x + 1 - a, 0.0
    c, d = 1e300, 1.0 / (x + 1 - a)
    f = d
    for n in range(1, 500):
        b += 2
        an = -n * (n - a)
        d, c = 1.0 / (an * d + b), b + an / c
        f *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return head * f


def _beta_part(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1.0 - _beta_part(b, a, 1 - x)
    head = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1.0 / (1 - (a + b) * x / (a + 1))
    f = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1.0 / (1 + num * d), 1 + num / c
            f *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return head * f


def _udf(fn):
    """Vectorised function over columns, built when used: a session must exist by then."""
    return lambda *columns: F.pandas_udf(fn, "double")(*columns)


def _normal(z: pd.Series) -> pd.Series:
    return z.map(lambda v: math.erfc(abs(v) / math.sqrt(2)), na_action="ignore")


def _chi2(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(v) else _gamma_tail(k / 2, v / 2) for v, k in zip(x, df)], dtype="float64")


def _student(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(v) else _beta_part(k / 2, 0.5, k / (k + v * v)) for v, k in zip(t, df)], dtype="float64")


normal_two_sided, chi2_tail, t_two_sided = _udf(_normal), _udf(_chi2), _udf(_student)
