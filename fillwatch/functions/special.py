"""Special functions Spark has no expression for, as Arrow-batched pandas UDFs."""

from __future__ import annotations

import math
from itertools import count

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _upper_gamma_ratio(a: float, x: float) -> float:
    """Regularized upper incomplete gamma function Q(a, x)."""
    if math.isnan(a) or math.isnan(x):
        return math.nan
    if x <= 0.0:
        return 1.0
    if math.isinf(x) or math.isinf(a):
        return 0.0 if math.isinf(x) else 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1.0:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1.0
            term *= x / k
            total += term
        return max(1.0 - front * total, 0.0)
    # modified Lentz evaluation of the continued fraction
    b = x + 1.0 - a
    c, d = 1e300, 1.0 / b
    h = d
    for k in count(1):
        an = -k * (k - a)
        b += 2.0
        d = 1.0 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        step = c * d
        h *= step
        if abs(step - 1.0) < 1e-15:
            break
    return front * h


def _beta_ratio(a: float, b: float, x: float) -> float:
    """Regularized incomplete beta function."""
    if any(map(math.isnan, (a, b, x))) or math.isinf(a) or math.isinf(b):
        return math.nan
    if x <= 0.0 or x >= 1.0:
        return 0.0 if x <= 0.0 else 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - _beta_ratio(b, a, 1.0 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1.0 / (1.0 - (a + b) * x / (a + 1.0) or 1e-300)
    h = d
    for m in count(1):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 / (1.0 + num * d or 1e-300)
            c = 1.0 + num / c or 1e-300
            h *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return front * h


def _t_quantile(p: float, dof: float) -> float:
    if p == 0.5:
        return 0.0
    if p < 0.5:
        return -_t_quantile(1.0 - p, dof)
    tail = lambda t: 0.5 * _beta_ratio(dof / 2.0, 0.5, dof / (dof + t * t))
    lo, hi = 0.0, 1.0
    while tail(hi) > 1.0 - p:
        lo, hi = hi, hi * 2.0
    for _ in range(200):
        mid = 0.5 * (lo + hi)
        lo, hi = (mid, hi) if tail(mid) > 1.0 - p else (lo, mid)
    return 0.5 * (lo + hi)


def _binom_quantile(q: float, n: int, p: float) -> float:
    """Smallest k with P(X <= k) >= q, by bisection on the incomplete beta function."""
    if q <= 0.0:
        return -1.0
    lo, hi = 0, int(n)
    while lo < hi:
        mid = (lo + hi) // 2
        cdf = 1.0 if mid >= n else _beta_ratio(n - mid, mid + 1.0, 1.0 - p)
        lo, hi = (lo, mid) if cdf >= q * (1.0 - 1e-12) else (mid + 1, hi)
    return float(lo)


@F.pandas_udf(T.DoubleType())
def chi2_sf(x: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(v) or pd.isna(k) else _upper_gamma_ratio(k / 2.0, v / 2.0)
                      for v, k in zip(x, dof)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def t_quantile(p: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) or pd.isna(k) or k <= 0 or math.isinf(k) or not 0 < a < 1 else _t_quantile(a, k)
                      for a, k in zip(p, dof)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def binom_quantile(q: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) or pd.isna(k) else _binom_quantile(a, int(k), b)
                      for a, k, b in zip(q, n, p)], dtype="float64")
