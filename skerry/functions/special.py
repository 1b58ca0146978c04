"""Special functions and distribution tails, for whole numpy arrays or scalars; nothing here needs Spark."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np

_TINY = 1e-300
_NORMAL = NormalDist()


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by a continued fraction, swapped to the side where it converges fast."""
    if not 0 < x < 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - betainc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1.0 / max(abs(1 - (a + b) * x / (a + 1)), _TINY) * math.copysign(1, 1 - (a + b) * x / (a + 1))
    total = d
    for m in range(1, 500):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + term * d
            d = 1 / (d if abs(d) > _TINY else _TINY)
            c = 1 + term / c
            c = c if abs(c) > _TINY else _TINY
            total *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * total


def gammainc(a: float, x: float) -> float:
    """Regularised lower incomplete gamma: a series below a + 1, else a continued fraction."""
    if x <= 0:
        return 0.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return min(1.0, front * total)
    b = x + 1 - a
    c, d = 1 / _TINY, 1 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / ((an * d + b) or _TINY)
        c = (b + an / c) or _TINY
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return 1.0 - front * h


def normal_cdf(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def normal_quantile(p: float) -> float:
    return _NORMAL.inv_cdf(p)


def t_cdf(t: float, df: float) -> float:
    half = 0.5 * betainc(df / 2, 0.5, df / (df + t * t))
    return 1 - half if t > 0 else half


def t_two_sided(t: float, df: float) -> float:
    return betainc(df / 2, 0.5, df / (df + t * t)) if df > 0 else float("nan")


def f_tail(f: float, d1: float, d2: float) -> float:
    return betainc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def chi2_tail(x: float, df: float) -> float:
    return 1.0 - gammainc(df / 2, x / 2)


def bisect(f, low: float, high: float, steps: int = 200) -> float:
    """Where the increasing ``f`` crosses zero."""
    for _ in range(steps):
        mid = (low + high) / 2
        if f(mid) < 0:
            low = mid
        else:
            high = mid
    return (low + high) / 2


def chi2_quantile(p: float, df: float) -> float:
    high = max(1.0, df)
    while gammainc(df / 2, high / 2) < p:
        high *= 2
    return bisect(lambda x: gammainc(df / 2, x / 2) - p, 0.0, high)


def t_quantile(p: float, df: float) -> float:
    high = 1.0
    while t_cdf(high, df) < max(p, 1 - p):
        high *= 2
    return bisect(lambda x: t_cdf(x, df) - p, -high, high)


def noncentral_t_cdf(t: float, df: float, shift: float) -> float:
    """Mean of the normal CDF at t s - shift over the scaled chi density of s, by Gauss-Legendre nodes."""
    spread = 1 / math.sqrt(2 * df)
    low, high = max(1e-9, 1 - 12 * spread), 1 + 12 * spread
    nodes, weights = np.polynomial.legendre.leggauss(200)
    s = (high - low) / 2 * nodes + (high + low) / 2
    log_density = math.log(2) + df / 2 * math.log(df / 2) - math.lgamma(df / 2) + (df - 1) * np.log(s) - df * s * s / 2
    values = np.array([normal_cdf(t * x - shift) for x in s])
    return float((weights * np.exp(log_density) * values).sum() * (high - low) / 2)


def noncentral_f_cdf(f: float, d1: float, d2: float, shift: float) -> float:
    """Poisson mixture of central tails."""
    x, total, weight_sum = d1 * f / (d1 * f + d2), 0.0, 0.0
    middle = int(shift / 2)
    reach = int(10 * math.sqrt(shift / 2 + 1)) + 30
    for j in range(max(0, middle - reach), middle + reach):
        w = math.exp(-shift / 2 + (j * math.log(shift / 2) if shift > 0 else (0.0 if j == 0 else -math.inf)) - math.lgamma(j + 1))
        total += w * betainc(d1 / 2 + j, d2 / 2, x)
        weight_sum += w
    return total / weight_sum


def poisson_pmf(k: int, mean: float) -> float:
    return math.exp(k * math.log(mean) - mean - math.lgamma(k + 1)) if mean > 0 else float(k == 0)


def poisson_interval(count: int, confidence: float = 0.95) -> tuple[float, float]:
    """Garwood's exact interval of a Poisson count."""
    tail = (1 - confidence) / 2
    return (chi2_quantile(tail, 2 * count) / 2 if count else 0.0), chi2_quantile(1 - tail, 2 * count + 2) / 2
