"""Upper tails of t, F, chi-squared and normal distributions, and the normal quantile, without scipy."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np


def _beta_fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function, by Lentz's method."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 10_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def beta_tail(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function I_x(a, b)."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1 - x) / b


def t_two_sided(t: float, df: float) -> float:
    """P(|T| > |t|); small tails keep their precision."""
    if df <= 0 or t != t:
        return math.nan
    return beta_tail(df / 2, 0.5, df / (df + t * t))


def beta_tails(a: np.ndarray, b: float, x: np.ndarray) -> np.ndarray:
    """beta_tail over arrays a and x of one length."""
    a, x = np.asarray(a, float), np.asarray(x, float)
    inner = (x > 0) & (x < 1)
    out = np.where(x >= 1, 1.0, 0.0)
    if not inner.any():
        return out
    a, x = a[inner], x[inner]
    const = {v: math.lgamma(v + b) - math.lgamma(v) - math.lgamma(b) for v in np.unique(a).tolist()}
    front = np.exp(np.array([const[v] for v in a.tolist()]) + a * np.log(x) + b * np.log1p(-x))
    low = x < (a + 1) / (a + b + 2)
    p, q, z = np.where(low, a, b), np.where(low, b, a), np.where(low, x, 1 - x)
    tiny = 1e-300
    guard = lambda v: np.where(np.abs(v) > tiny, v, tiny)
    c, d = np.ones_like(z), 1 / guard(1 - (p + q) * z / (p + 1))
    h = d.copy()
    left = np.arange(len(z))
    for m in range(1, 10_000):
        pl, ql, zl = p[left], q[left], z[left]
        for num in (m * (ql - m) * zl / ((pl + 2 * m - 1) * (pl + 2 * m)), -(pl + m) * (pl + ql + m) * zl / ((pl + 2 * m) * (pl + 2 * m + 1))):
            d[left] = 1 / guard(1 + num * d[left])
            c[left] = guard(1 + num / c[left])
            h[left] *= d[left] * c[left]
        left = left[np.abs(d[left] * c[left] - 1) >= 1e-15]
        if not len(left):
            break
    got = front * h / p
    out[inner] = np.where(low, got, 1 - got)
    return out


def t_two_sided_all(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """t_two_sided over arrays; df is above 0."""
    return beta_tails(np.asarray(df) / 2, 0.5, df / (df + np.asarray(t) ** 2))


def f_upper_all(f: np.ndarray, d1: float, d2: np.ndarray) -> np.ndarray:
    """f_upper over arrays of f and d2."""
    return np.where(np.asarray(f) <= 0, 1.0, beta_tails(np.asarray(d2) / 2, d1 / 2, d2 / (d2 + d1 * np.maximum(f, 0))))


def f_upper(f: float, d1: float, d2: float) -> float:
    """P(F > f)."""
    if f <= 0:
        return 1.0
    return beta_tail(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def chi2_upper(x: float, df: float) -> float:
    """P(chi-squared > x): the regularised upper incomplete gamma function."""
    a, x = df / 2, x / 2
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        n = a
        while term > total * 1e-17:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1.0 - front * total)
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1 / (d if abs(d) > tiny else tiny)
        c = b + an / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def normal_quantile(p: float) -> float:
    """The standard normal quantile; infinite at 0 and 1."""
    if not 0 < p < 1:
        return math.nan if not 0 <= p <= 1 else math.copysign(math.inf, p - 0.5)
    return NormalDist().inv_cdf(p)
