"""Tail probabilities for the few rows of a test result.

Each function is a vectorised UDF over a small aggregated frame; the statistics themselves are
column arithmetic on the executors.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F

TINY = 1e-300


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0.0 or x >= 1.0:
        return 0.0 if x <= 0.0 else 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - incomplete_beta(b, a, 1.0 - x)
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    ) / a
    # modified Lentz evaluation: f = 1 + d1/(1 + d2/(1 + ...))
    value, c, d = 1.0, 1.0, 0.0
    for i in range(0, 400):
        m = i // 2
        if i == 0:
            term = 1.0
        elif i % 2 == 0:
            term = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            term = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1.0 + term * d
        d = 1.0 / (d if abs(d) > TINY else TINY)
        c = 1.0 + term / c
        c = c if abs(c) > TINY else TINY
        value *= c * d
        if abs(c * d - 1.0) < 1e-15:
            return front * (value - 1.0)
    return float("nan")  # the fraction did not settle


def upper_gamma(s: float, x: float) -> float:
    """Regularised upper incomplete gamma function: series below s + 1, continued fraction above."""
    if x <= 0.0:
        return 1.0
    front = math.exp(s * math.log(x) - x - math.lgamma(s))
    if x < s + 1.0:
        term = total = 1.0 / s
        k = s
        while abs(term) > abs(total) * 1e-17:
            k += 1.0
            term *= x / k
            total += term
        return 1.0 - front * total
    b = x + 1.0 - s
    c, d = 1.0 / TINY, 1.0 / b
    value = d
    for i in range(1, 10000):
        a = -i * (i - s)
        b += 2.0
        d = a * d + b
        d = 1.0 / (d if abs(d) > TINY else TINY)
        c = b + a / c
        c = c if abs(c) > TINY else TINY
        value *= c * d
        if abs(c * d - 1.0) < 1e-16:
            return front * value
    return float("nan")  # the fraction did not settle


def t_tail(t: float, df: float) -> float:
    """Two-sided tail of Student's t."""
    if t is None or df is None or math.isnan(t) or math.isnan(df):
        return float("nan")
    if math.isinf(t):
        return 0.0
    return incomplete_beta(df / 2.0, 0.5, df / (df + t * t))


def t_quantile(p: float, df: float) -> float:
    """Upper quantile of Student's t (p > 0.5) by bisection on the tail."""
    if p is None or df is None or math.isnan(df):
        return float("nan")
    target = 2.0 * (1.0 - p)
    low, high = 0.0, 1.0
    while t_tail(high, df) > target:
        high *= 2.0
    for _ in range(200):
        mid = (low + high) / 2.0
        low, high = (mid, high) if t_tail(mid, df) > target else (low, mid)
    return (low + high) / 2.0


def _vectorised(function):
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(x) or pd.isna(y) else function(float(x), float(y)) for x, y in zip(a, b)], dtype="float64")

    return F.pandas_udf(run, "double")


def t_p_value(t, df):
    """Two-sided p-value of a t statistic."""
    return _vectorised(t_tail)(t.cast("double"), df.cast("double"))


def t_critical(p: float, df):
    return _vectorised(t_quantile)(F.lit(p), df.cast("double"))


def chi_square_p_value(statistic, dof):
    return _vectorised(lambda x, k: upper_gamma(k / 2.0, x / 2.0) if k > 0 else 1.0)(statistic.cast("double"), dof.cast("double"))
