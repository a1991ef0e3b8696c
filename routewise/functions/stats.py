"""Distribution functions for the experiment statistics.

Spark SQL has no t / chi-square CDF, so p-values are computed by pandas UDFs
(Arrow batches) over the per-metric result rows, which are a handful of rows
after the distributed aggregation; the statistics themselves are Column
expressions.  Numerical method: regularised incomplete beta by the modified
Lentz continued fraction; upper chi-square tail with dof 1 is erfc(sqrt(x/2)),
other dof via the regularised upper incomplete gamma.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_EPS = 1e-15
_TINY = 1e-300


def _beta_cf(a: float, b: float, x: float) -> float:
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c, d = 1.0, 1.0 - qab * x / qap
    d = 1.0 / (d if abs(d) > _TINY else _TINY)
    h = d
    for m in range(1, 10000):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > _TINY else _TINY)
        c = 1.0 + aa / c
        c = c if abs(c) > _TINY else _TINY
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > _TINY else _TINY)
        c = 1.0 + aa / c
        c = c if abs(c) > _TINY else _TINY
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < _EPS:
            break
    return h


def betainc_reg(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    ln_front = (math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
                + a * math.log(x) + b * math.log1p(-x))
    front = math.exp(ln_front)
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_cf(a, b, x) / a
    return 1.0 - front * _beta_cf(b, a, 1.0 - x) / b


def t_sf_two_sided(t: float, df: float) -> float:
    """P(|T| >= |t|) for Student's t with ``df`` degrees of freedom."""
    if t is None or df is None or math.isnan(t) or math.isnan(df) or df <= 0:
        return float("nan")
    if math.isinf(t):
        return 0.0
    return betainc_reg(df / 2.0, 0.5, df / (df + t * t))


def _gammainc_upper_reg(s: float, x: float) -> float:
    """Q(s, x) = Gamma(s, x) / Gamma(s)."""
    if x <= 0:
        return 1.0
    if x < s + 1.0:  # series for P, then complement
        term = total = 1.0 / s
        n = s
        for _ in range(10000):
            n += 1.0
            term *= x / n
            total += term
            if abs(term) < abs(total) * _EPS:
                break
        return 1.0 - total * math.exp(-x + s * math.log(x) - math.lgamma(s))
    b = x + 1.0 - s  # continued fraction for Q
    c, d = 1.0 / _TINY, 1.0 / b
    h = d
    for i in range(1, 10000):
        an = -i * (i - s)
        b += 2.0
        d = an * d + b
        d = 1.0 / (d if abs(d) > _TINY else _TINY)
        c = b + an / c
        c = c if abs(c) > _TINY else _TINY
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < _EPS:
            break
    return math.exp(-x + s * math.log(x) - math.lgamma(s)) * h


def chi2_sf(x: float, dof: int) -> float:
    """Upper tail of chi-square; dof 0 (degenerate table) gives 1."""
    if x is None or dof is None or math.isnan(x):
        return float("nan")
    if dof <= 0:
        return 1.0
    if dof == 1:
        return math.erfc(math.sqrt(max(x, 0.0) / 2.0))
    return _gammainc_upper_reg(dof / 2.0, x / 2.0)


@F.pandas_udf(T.DoubleType())
def t_pvalue(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided Student t p-value (vectorised over Arrow batches)."""
    return pd.Series([t_sf_two_sided(a, b) for a, b in zip(t, df)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def chi2_pvalue(x: pd.Series, dof: pd.Series) -> pd.Series:
    """Chi-square upper-tail p-value."""
    return pd.Series([chi2_sf(a, int(b)) if b == b else float("nan") for a, b in zip(x, dof)],
                     dtype="float64")
