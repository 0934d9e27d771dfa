"""Tail probabilities of the normal family, as Arrow-batched column functions.

They run on result rows (one per test), never on policy rows.  The incomplete gamma
and beta functions use the textbook series and continued fractions (Press et al.,
Numerical Recipes; Abramowitz & Stegun 6.5 and 26.5).
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import DoubleType

_EPS = 1e-15
_TINY = 1e-300
_STEPS = 10_000


def gamma_tail(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function Q(a, x)."""
    if x <= 0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        n = a
        for _ in range(_STEPS):
            n += 1
            term *= x / n
            total += term
            if term < total * _EPS:
                break
        return max(0.0, 1.0 - total * scale)
    b = x + 1 - a
    c, d = 1 / _TINY, 1 / b
    h = d
    for i in range(1, _STEPS):
        an = -i * (i - a)
        b += 2
        d = 1 / _nonzero(an * d + b)
        c = _nonzero(b + an / c)
        step = c * d
        h *= step
        if abs(step - 1) < _EPS:
            break
    return min(1.0, h * scale)


def _nonzero(v: float) -> float:
    return v if abs(v) > _TINY else _TINY


def beta_lower(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function I_x(a, b)."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    front = math.exp(
        math.lgamma(a + b)
        - math.lgamma(a)
        - math.lgamma(b)
        + a * math.log(x)
        + b * math.log1p(-x)
    )
    # The fraction converges fast on this side of the mean; mirror otherwise.
    if x < (a + 1) / (a + b + 2):
        return min(1.0, front * _beta_fraction(a, b, x) / a)
    return max(0.0, 1.0 - front * _beta_fraction(b, a, 1 - x) / b)


def _beta_fraction(a: float, b: float, x: float) -> float:
    c = 1.0
    d = 1 / _nonzero(1 - (a + b) * x / (a + 1))
    h = d
    for m in range(1, _STEPS):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d = 1 / _nonzero(1 + even * d)
        c = _nonzero(1 + even / c)
        h *= c * d
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / _nonzero(1 + odd * d)
        c = _nonzero(1 + odd / c)
        step = c * d
        h *= step
        if abs(step - 1) < _EPS:
            break
    return h


def chi2_tail(x: float, dof: float) -> float:
    if dof == 0:
        return 1.0  # nothing can vary: the statistic is 0 with certainty
    return gamma_tail(dof / 2, x / 2)


def t_tails(t: float, dof: float) -> float:
    """Two-sided tail of Student's t."""
    if math.isinf(t):
        return 0.0
    return beta_lower(dof / 2, 0.5, dof / (dof + t * t))


def f_tail(f: float, d1: float, d2: float) -> float:
    if f <= 0:
        return 1.0
    if math.isinf(f):
        return 0.0
    return beta_lower(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def _mapped(function, *series: pd.Series) -> pd.Series:
    def one(values):
        if any(v is None or math.isnan(v) for v in values):
            return None
        return function(*values)

    return pd.Series([one(v) for v in zip(*series)], dtype="float64")


@F.pandas_udf(DoubleType())
def _chi2(x: pd.Series, dof: pd.Series) -> pd.Series:
    return _mapped(chi2_tail, x, dof)


@F.pandas_udf(DoubleType())
def _t(t: pd.Series, dof: pd.Series) -> pd.Series:
    return _mapped(t_tails, t, dof)


@F.pandas_udf(DoubleType())
def _f(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return _mapped(f_tail, f, d1, d2)


@F.pandas_udf(DoubleType())
def _by_kind(kind: pd.Series, x: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    def one(k, value, first, second):
        given = [value, first] + ([second] if k == "f" else [])
        if any(v is None or math.isnan(v) for v in given):
            return None
        return {"chi2": chi2_tail, "t": t_tails, "f": f_tail}[k](*given)

    return pd.Series([one(*v) for v in zip(kind, x, d1, d2)], dtype="float64")


def tail_p(kind: Column, statistic: Column, d1: Column, d2: Column) -> Column:
    """P-value of a "chi2", "t" or "f" statistic, for tables that mix them."""
    return _by_kind(kind, _double(statistic), _double(d1), _double(d2))


def _double(c: Column) -> Column:
    return c.cast("double")


def chi2_p(statistic: Column, dof: Column) -> Column:
    return _chi2(_double(statistic), _double(dof))


def t_p(statistic: Column, dof: Column) -> Column:
    return _t(_double(statistic), _double(dof))


def f_p(statistic: Column, d1: Column, d2: Column) -> Column:
    return _f(_double(statistic), _double(d1), _double(d2))
