"""Shapiro-Wilk W and its p-value after Royston (1995), algorithm AS R94.

Works on one bounded sample (at most 5000 values), handed over as an array column.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np

from riskweft.functions.pvalues import normal_tail

# Polynomial coefficients of Royston (1995), by rising power: fixed values.
_A_LAST = (0.0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056)
_A_SECOND = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
_G_SMALL = (-2.273, 0.459)
_M_SMALL = (0.5440, -0.39978, 0.025054, -0.0006714)
_S_SMALL = (1.3822, -0.77857, 0.062767, -0.0020322)
_M_LARGE = (-1.5861, -0.31082, -0.083751, 0.0038915)
_S_LARGE = (-0.4803, -0.082676, 0.0030302)


def _poly(coefficients, x: float) -> float:
    return sum(c * x**i for i, c in enumerate(coefficients))


def _weights(n: int) -> np.ndarray:
    if n == 3:
        return np.array([-math.sqrt(0.5), 0.0, math.sqrt(0.5)])
    quantile = NormalDist().inv_cdf
    m = np.array([quantile((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    squares = float(m @ m)
    u = 1 / math.sqrt(n)
    a = np.empty(n)
    last = m[-1] / math.sqrt(squares) + _poly(_A_LAST, u)
    if n > 5:
        second = m[-2] / math.sqrt(squares) + _poly(_A_SECOND, u)
        rest = (squares - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * second**2)
        a[2:-2] = m[2:-2] / math.sqrt(rest)
        a[-2], a[1] = second, -second
    else:
        rest = (squares - 2 * m[-1] ** 2) / (1 - 2 * last**2)
        a[1:-1] = m[1:-1] / math.sqrt(rest)
    a[-1], a[0] = last, -last
    return a


def shapiro_wilk(values) -> tuple[float | None, float | None]:
    """``(W, p)``; nulls for fewer than 3 values, (1, 1) for a constant sample."""
    x = np.sort(np.asarray([v for v in values if v is not None], dtype=float))
    n = len(x)
    if n < 3:
        return None, None
    centred = x - x.mean()
    spread = float(centred @ centred)
    if spread == 0:
        return 1.0, 1.0
    w = min(1.0, float(_weights(n) @ x) ** 2 / spread)
    if n == 3:
        p = 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75)))
        return w, min(1.0, max(0.0, p))
    if w >= 1:
        return w, 1.0
    y = math.log1p(-w)
    if n <= 11:
        limit = _poly(_G_SMALL, n)
        if y >= limit:
            return w, 0.0
        y = -math.log(limit - y)
        mean, sd = _poly(_M_SMALL, n), math.exp(_poly(_S_SMALL, n))
    else:
        size = math.log(n)
        mean, sd = _poly(_M_LARGE, size), math.exp(_poly(_S_LARGE, size))
    return w, normal_tail((y - mean) / sd)
