"""Shapiro-Wilk W test for one small sample (Royston 1995)."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np

from plumbline.functions.shipping import ship_by_value

# Royston's polynomial coefficients, low order first.
_C1 = (0.0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056)
_C2 = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
_GAMMA = (-2.273, 0.459)
_MU_SMALL = (0.5440, -0.39978, 0.025054, -6.714e-4)
_LOG_SIGMA_SMALL = (1.3822, -0.77857, 0.062767, -0.0020322)
_MU_LARGE = (-1.5861, -0.31082, -0.083751, 0.0038915)
_LOG_SIGMA_LARGE = (-0.4803, -0.082676, 0.0030302)

_NORMAL = NormalDist()


def _poly(coefficients: tuple[float, ...], x: float) -> float:
    return float(np.polynomial.polynomial.polyval(x, coefficients))


def _weights(n: int) -> np.ndarray:
    """Antisymmetric weights of the ordered sample, for n >= 4."""
    m = np.array([_NORMAL.inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    ssq = float(m @ m)
    u = 1.0 / math.sqrt(n)
    last = m[-1] / math.sqrt(ssq) + _poly(_C1, u)
    weights = np.empty(n)
    if n <= 5:
        phi = (ssq - 2 * m[-1] ** 2) / (1 - 2 * last**2)
        weights[1:-1] = m[1:-1] / math.sqrt(phi)
    else:
        second = m[-2] / math.sqrt(ssq) + _poly(_C2, u)
        phi = (ssq - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * second**2)
        weights[2:-2] = m[2:-2] / math.sqrt(phi)
        weights[-2], weights[1] = second, -second
    weights[-1], weights[0] = last, -last
    return weights


def shapiro_wilk(values: np.ndarray) -> tuple[float, float] | None:
    """(W, p) of the sample, or None for fewer than 4 values or a constant sample."""
    x = np.sort(np.asarray(values, dtype=float))
    x = x[~np.isnan(x)]
    n = x.size
    if n < 4 or x[0] == x[-1] or not np.isfinite(x).all():
        return None
    centred = x - x.mean()
    scatter = float(centred @ centred)
    if not math.isfinite(scatter) or scatter <= 0.0:
        return None
    w = min(1.0, float(_weights(n) @ centred) ** 2 / scatter)
    if w >= 1.0:
        return 1.0, 1.0
    if n <= 11:
        gap = _poly(_GAMMA, n) - math.log(1 - w)
        if gap <= 0:
            return w, 0.0
        y, at = -math.log(gap), float(n)
        mu, sigma = _poly(_MU_SMALL, at), math.exp(_poly(_LOG_SIGMA_SMALL, at))
    else:
        y, at = math.log(1 - w), math.log(n)
        mu, sigma = _poly(_MU_LARGE, at), math.exp(_poly(_LOG_SIGMA_LARGE, at))
    return w, 1.0 - _NORMAL.cdf((y - mu) / sigma)


ship_by_value(__name__)
