"""Power and sample size, over a DataFrame of designs (one row a design, Arrow batches of scalars)."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from skerry.functions import special


def ttest_power(n: float, d: float, alpha: float = 0.05, two_sided: bool = True) -> float:
    """Power of a two-sample t-test with n a group."""
    if n < 2:
        return 0.0
    if d == 0:
        return alpha
    df, shift = 2 * n - 2, abs(d) * math.sqrt(n / 2)
    if shift > 37:
        return 1.0
    t = special.t_quantile(1 - (alpha / 2 if two_sided else alpha), df)
    power = 1 - special.noncentral_t_cdf(t, df, shift)
    return min(1.0, power + (special.noncentral_t_cdf(-t, df, shift) if two_sided else 0.0))


def anova_power(n: float, f: float, k: int, alpha: float = 0.05) -> float:
    """Power of a one-way F-test with n in each of k groups."""
    if n < 2:
        return 0.0
    if f == 0:
        return alpha
    d1, d2 = k - 1, k * (n - 1)
    critical = special.bisect(lambda x: alpha - special.f_tail(x, d1, d2), 0.0, 1e4)
    return 1 - special.noncentral_f_cdf(critical, d1, d2, f * f * n * k)


def least_n(power_of, target: float = 0.8, high: int = 1_000_000) -> int | None:
    """Least whole n whose power reaches the target; none up to ``high`` gives None."""
    low = 2
    if power_of(low) >= target:
        return low
    top = 4
    while power_of(top) < target:
        top *= 2
        if top > high:
            return None
    while top - low > 1:
        mid = (low + top) // 2
        if power_of(mid) >= target:
            top = mid
        else:
            low = mid
    return top


def _over(kind: str, call):
    @F.pandas_udf(kind)
    def run(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([call(*row) for row in zip(a, b, c, d)])

    return run


def t_power(n: Column, effect: Column, alpha: float = 0.05) -> Column:
    return _over("double", lambda n, d, a, _: ttest_power(n, d, a))(n.cast("double"), effect.cast("double"), F.lit(alpha), F.lit(0))


def f_power(n: Column, effect: Column, groups: Column, alpha: float = 0.05) -> Column:
    return _over("double", lambda n, f, k, a: anova_power(n, f, int(k), a))(n.cast("double"), effect.cast("double"), groups, F.lit(alpha))


def n_for_t(effect: Column, power: float = 0.8, alpha: float = 0.05) -> Column:
    """Least n a group; null if the effect is 0 or less."""
    return _over("long", lambda d, p, a, _: least_n(lambda n: ttest_power(n, d, a), p) if d > 0 else None)(effect.cast("double"), F.lit(power), F.lit(alpha), F.lit(0))


def n_for_f(effect: Column, groups: Column, power: float = 0.8, alpha: float = 0.05) -> Column:
    return _over("long", lambda f, k, p, a: least_n(lambda n: anova_power(n, f, int(k), a), p) if f > 0 else None)(effect.cast("double"), groups, F.lit(power), F.lit(alpha))


def detectable(n: Column, groups: Column, power: float = 0.8, alpha: float = 0.05) -> Column:
    """Least effect (d for two groups, f for more) that n a group detects with the power."""
    find = lambda n, k, p, a: special.bisect(lambda e: (ttest_power(n, e, a) if k == 2 else anova_power(n, e, int(k), a)) - p, 1e-4, 50.0, 60)
    return _over("double", find)(n.cast("double"), groups, F.lit(power), F.lit(alpha))
