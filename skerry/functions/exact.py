"""Exact null distributions of rank and permutation tests, and the Shapiro-Wilk test.  Inputs are small by nature."""

from __future__ import annotations

import functools
import itertools
import math

import numpy as np

from skerry.functions.special import chi2_tail, normal_cdf, normal_quantile, normal_two_sided

#: Up to this size the rank tests use exact nulls when there are no ties (scipy's rule of thumb).
EXACT_MANN_WHITNEY, EXACT_WILCOXON = 8, 50
#: Greatest n m whose exact Mann-Whitney null is listed; the normal form serves beyond.
MAX_EXACT_ORDERS = 100_000


@functools.lru_cache(maxsize=256)
def mann_whitney_counts(n: int, m: int) -> tuple[int, ...]:
    """How many orders of n and m values have U = 0, 1, ..., n m: the Gaussian binomial's coefficients."""
    top = n * m
    ways = [1] + [0] * top
    for i in range(1, n + 1):
        for u in range(top, m + i - 1, -1):
            ways[u] -= ways[u - m - i]
        for u in range(i, top + 1):
            ways[u] += ways[u - i]
    return tuple(ways)


def mann_whitney_p(u: float, n: int, m: int, tie_term: float) -> float:
    """Two-sided p; ``tie_term`` is the sum of t^3 - t over tied values."""
    greater = max(u, n * m - u)
    if tie_term == 0 and min(n, m) <= EXACT_MANN_WHITNEY and n * m <= MAX_EXACT_ORDERS:
        n, m = int(n), int(m)
        ways = mann_whitney_counts(n, m)
        return min(1.0, 2 * sum(ways[int(math.ceil(greater)) :]) / math.comb(n + m, n))
    total = n + m
    spread = math.sqrt(n * m / 12 * ((total + 1) - tie_term / (total * (total - 1))))
    return min(1.0, 2 * (1 - normal_cdf((greater - n * m / 2 - 0.5) / spread))) if spread else 1.0


@functools.lru_cache(maxsize=128)
def signed_rank_counts(n: int) -> tuple[int, ...]:
    """How many sign patterns of ranks 1..n have each sum of positive ranks."""
    ways = [1] + [0] * (n * (n + 1) // 2)
    for r in range(1, n + 1):
        for s in range(len(ways) - 1, r - 1, -1):
            ways[s] += ways[s - r]
    return tuple(ways)


def wilcoxon_p(w_plus: float, n: int, tie_term: float, zeros: int = 0) -> float:
    """Two-sided p of the signed-rank sum over n non-zero differences."""
    n = int(n)
    if n == 0:
        return 1.0
    if tie_term == 0 and zeros == 0 and n <= EXACT_WILCOXON:
        ways = signed_rank_counts(n)
        low, high = sum(ways[: int(w_plus) + 1]), sum(ways[int(math.ceil(w_plus)) :])
        return min(1.0, 2 * min(low, high) / 2**n)
    spread = math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - tie_term / 48)
    return normal_two_sided((w_plus - n * (n + 1) / 4) / spread) if spread else 1.0


def fisher_p(a: int, b: int, c: int, d: int) -> float:
    """Two-sided Fisher test of [[a, b], [c, d]]: all tables as improbable as the observed one."""
    row, column, total = a + b, a + c, a + b + c + d

    def log_p(x: int) -> float:
        return sum(math.lgamma(v + 1) for v in (row, total - row, column, total - column)) - sum(math.lgamma(v + 1) for v in (total, x, row - x, column - x, total - row - column + x))

    tables = [log_p(x) for x in range(max(0, row + column - total), min(row, column) + 1)]
    observed = log_p(a)
    return min(1.0, sum(math.exp(p) for p in tables if p <= observed + 1e-7))


def permutation_p(x: np.ndarray, y: np.ndarray, limit: int = 9_999, seed: int = 20260901) -> tuple[float, bool]:
    """Two-sided p of the mean difference: twice the smaller one-sided p.  Exact if there are at most ``limit`` splits."""
    pool, n = np.concatenate([x, y]), len(x)
    observed = x.mean() - y.mean()
    total, m = pool.sum(), len(pool) - n
    difference = lambda s: s / n - (total - s) / m
    slack = 1e-12 * max(1.0, abs(observed))
    if math.comb(len(pool), n) <= limit:
        null = difference(np.array([pool[list(c)].sum() for c in itertools.combinations(range(len(pool)), n)]))
        low, high, size = (null <= observed + slack).sum(), (null >= observed - slack).sum(), len(null)
        return min(1.0, 2 * min(low, high) / size), True
    rng = np.random.default_rng(seed)
    null = difference(np.array([rng.permutation(pool)[:n].sum() for _ in range(limit)]))
    low, high = (null <= observed + slack).sum() + 1, (null >= observed - slack).sum() + 1
    return min(1.0, 2 * min(low, high) / (limit + 1)), False


def shapiro(values: np.ndarray) -> tuple[float, float]:
    """W and p by Royston's 1995 approximation (algorithm AS R94), for 3 to 5 000 values that aren't all equal."""
    x = np.sort(np.asarray(values, float))
    n = len(x)
    if n < 3 or x[0] == x[-1]:
        return math.nan, math.nan
    m = np.array([normal_quantile((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    norm, root = float(m @ m), 1 / math.sqrt(n)
    a = np.zeros(n)
    if n == 3:
        a[-1] = math.sqrt(0.5)
    else:
        # Fixed values of the published algorithm: corrections of the outermost weights.
        a[-1] = np.polyval([-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, m[-1] / math.sqrt(norm)], root)
        first = 1
        if n > 5:
            a[-2] = np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, m[-2] / math.sqrt(norm)], root)
            first = 2
            scale = (norm - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * a[-1] ** 2 - 2 * a[-2] ** 2)
        else:
            scale = (norm - 2 * m[-1] ** 2) / (1 - 2 * a[-1] ** 2)
        a[first : n - first] = m[first : n - first] / math.sqrt(scale)
    for k in range(n // 2):
        a[k] = -a[n - 1 - k]
    w = min(1.0, float((a @ x) ** 2 / ((x - x.mean()) ** 2).sum()))
    if n == 3:
        p = 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75)))
        return w, min(1.0, max(0.0, p))
    y = math.log(1 - w) if w < 1 else -745.0
    # Fixed values of the published algorithm: mean and spread of the transformed W.
    if n <= 11:
        gamma = -2.273 + 0.459 * n
        if y >= gamma:
            return w, 0.0
        y = -math.log(gamma - y)
        mean, spread = np.polyval([-0.0006714, 0.025054, -0.39978, 0.5440], n), math.exp(np.polyval([-0.0020322, 0.062767, -0.77857, 1.3822], n))
    else:
        size = math.log(n)
        mean, spread = np.polyval([0.0038915, -0.083751, -0.31082, -1.5861], size), math.exp(np.polyval([0.0030302, -0.082676, -0.4803], size))
    return w, 1 - normal_cdf((y - mean) / spread)


def alexander_govern(n: np.ndarray, mean: np.ndarray, variance: np.ndarray) -> tuple[float, float]:
    """Statistic and p for groups of unequal variance, from their sizes, means and variances."""
    error2 = variance / n
    weight = 1 / error2 / (1 / error2).sum()
    t = (mean - (weight * mean).sum()) / np.sqrt(error2)
    v = n - 1
    a = v - 0.5
    b = 48 * a * a
    c = np.sqrt(a * np.log1p(t * t / v))
    z = c + (c**3 + 3 * c) / b - (4 * c**7 + 33 * c**5 + 240 * c**3 + 855 * c) / (b * b * 10 + 8 * b * c**4 + 1000 * b)
    statistic = float((z * z).sum())
    return statistic, chi2_tail(statistic, len(n) - 1)
