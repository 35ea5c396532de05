"""Numeric kernels of the distributions, over numpy arrays, from published formulas.

Series and continued fractions run until all elements have converged; inverses bisect on a bracket.
"""

from __future__ import annotations

import math

import numpy as np

_EPS = 1e-16
# Lanczos coefficients for g = 7.
_LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln of the gamma function for x > 0."""
    x = np.asarray(x, float)
    low = x < 0.5
    z = np.where(low, 1 - x, x) - 1
    s = _LANCZOS[0] + sum(c / (z + i) for i, c in enumerate(_LANCZOS[1:], 1))
    t = z + 7.5
    out = 0.5 * math.log(2 * math.pi) + (z + 0.5) * np.log(t) - t + np.log(s)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(low, np.log(math.pi / np.abs(np.sin(math.pi * x))) - out, out)


def gamma_pq(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Regularised incomplete gamma functions P and Q for a > 0, x >= 0."""
    a, x = (np.array(v, float) for v in np.broadcast_arrays(a, x))
    p = np.zeros(a.shape)
    with np.errstate(all="ignore"):
        front = np.exp(a * np.log(x) - x - log_gamma(a))
        series = x < a + 1
        term, total = 1 / a, 1 / a
        for n in range(1, 20_000):
            term = np.where(series, term * x / (a + n), 0)
            total = total + term
            if (np.abs(term) <= np.abs(total) * _EPS).all():
                break
        b = x + 1 - a
        c, d = np.full(a.shape, 1e300), 1 / np.where(b == 0, 1e-300, b)
        h = d.copy()
        for n in range(1, 20_000):
            an = -n * (n - a)
            b = b + 2
            d = 1 / _away(an * d + b)
            c = _away(b + an / c)
            h = np.where(series, h, h * d * c)
            if (series | (np.abs(d * c - 1) < 1e-15)).all():
                break
        p = np.where(series, total * front, 1 - h * front)
        q = np.where(series, 1 - total * front, h * front)
    zero, inf = x <= 0, np.isinf(x)
    return np.where(zero, 0.0, np.where(inf, 1.0, np.clip(p, 0, 1))), np.where(zero, 1.0, np.where(inf, 0.0, np.clip(q, 0, 1)))


def _away(v: np.ndarray) -> np.ndarray:
    return np.where(np.abs(v) < 1e-300, 1e-300, v)


def beta_pq(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Regularised incomplete beta function I_x(a, b) and its complement for a, b > 0."""
    a, b, x = (np.array(v, float) for v in np.broadcast_arrays(a, b, x))
    x = np.clip(x, 0, 1)
    swap = x > (a + 1) / (a + b + 2)
    a, b, y = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    with np.errstate(all="ignore"):
        front = np.exp(a * np.log(y) + b * np.log1p(-y) + log_gamma(a + b) - log_gamma(a) - log_gamma(b)) / a
        c, d = np.ones(a.shape), 1 / _away(1 - (a + b) * y / (a + 1))
        h = d.copy()
        for m in range(1, 20_000):
            for num in (m * (b - m) * y / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * y / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 / _away(1 + num * d)
                c = _away(1 + num / c)
                h = h * d * c
            if (np.abs(d * c - 1) < 1e-15).all():
                break
        own = np.clip(np.where(y <= 0, 0.0, front * h), 0, 1)
    return np.where(swap, 1 - own, own), np.where(swap, own, 1 - own)


_erfc = np.vectorize(math.erfc, otypes=[float])


def normal_pq(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    z = np.asarray(z, float)
    return 0.5 * _erfc(-z / math.sqrt(2)), 0.5 * _erfc(z / math.sqrt(2))


def poisson_mixture(mean: np.ndarray, of, x: np.ndarray) -> np.ndarray:
    """Sum over k of the Poisson weight of k times of(k), outward from the mode until weights vanish."""
    mean = np.asarray(mean, float)
    mode = np.floor(mean)
    weight = lambda k: np.where(mean > 0, np.exp(-mean + k * np.log(np.maximum(mean, 1e-300)) - log_gamma(k + 1)), (k == 0) * 1.0)
    total = np.zeros(np.broadcast(mean, x).shape)
    for step, first in ((1, 0), (-1, 1)):
        for i in range(first, 100_000):
            k = mode + step * i
            w = np.where(k >= 0, weight(np.maximum(k, 0)), 0)
            total = total + w * of(np.maximum(k, 0))
            if (w < 1e-17).all():
                break
    return total


def bisect(cdf, p: np.ndarray, q: np.ndarray, low: np.ndarray, high: np.ndarray, steps: int = 200) -> np.ndarray:
    """x with cdf(x) = (p, q) on [low, high], by the smaller of both tails."""
    low, high, p, q = (np.array(v, float) for v in np.broadcast_arrays(low, high, p, q))
    upper = q < p
    for _ in range(steps):
        mid = (low + high) / 2
        a, b = cdf(mid)
        under = np.where(upper, b > q, a < p)
        low, high = np.where(under, mid, low), np.where(under, high, mid)
        if (high - low <= 4e-16 * np.maximum(1e-300, np.abs(high))).all():
            break
    return (low + high) / 2


def bracket(cdf, p: np.ndarray, q: np.ndarray, start: float, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """An interval that holds the inverse, grown from start; floor is the lower end of the support, or -inf."""
    high = np.full(np.shape(p), float(start))
    for _ in range(400):
        a, b = cdf(high)
        more = np.where(q < p, b > q, a < p)
        if not more.any():
            break
        high = np.where(more, high * 2, high)
    if floor > -np.inf:
        return np.full(high.shape, float(floor)), high
    low = -np.full(np.shape(p), float(start))
    for _ in range(400):
        a, b = cdf(low)
        more = np.where(q < p, b < q, a > p)
        if not more.any():
            break
        low = np.where(more, low * 2, low)
    return low, high
