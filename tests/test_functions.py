"""Special functions against commons-math (shipped with Spark), exact nulls against enumeration, kernels against known answers."""

import itertools
import math

import numpy as np
import pytest

from skerry.functions import exact, special
from skerry.operators import curves, neighbours, power, simulate


def test_tails_equal_commons_math(spark):
    d = spark._jvm.org.apache.commons.math3.distribution
    for t, df in ((0.3, 2.0), (2.0, 10.0), (-1.7, 5.5), (6.0, 40.0)):
        assert special.t_cdf(t, df) == pytest.approx(d.TDistribution(df).cumulativeProbability(t), abs=1e-10)
        assert special.t_two_sided(t, df) == pytest.approx(2 * d.TDistribution(df).cumulativeProbability(-abs(t)), abs=1e-10)
    for f, a, b in ((3.0, 2.0, 10.0), (0.4, 5.0, 7.0), (12.0, 3.0, 50.0)):
        assert special.f_tail(f, a, b) == pytest.approx(1 - d.FDistribution(a, b).cumulativeProbability(f), abs=1e-10)
    for x, df in ((0.5, 1.0), (9.3484, 3.0), (80.0, 60.0)):
        assert special.chi2_tail(x, df) == pytest.approx(1 - d.ChiSquaredDistribution(df).cumulativeProbability(x), abs=1e-10)
    assert special.chi2_quantile(0.975, 3) == pytest.approx(9.348404, abs=1e-5)
    assert special.poisson_pmf(0, 3) == pytest.approx(0.0498, abs=1e-4)


def test_mann_whitney_counts_by_enumeration():
    n, m = 3, 4
    found = [0] * (n * m + 1)
    for c in itertools.combinations(range(n + m), n):
        found[sum(c) - n * (n - 1) // 2] += 1
    assert exact.mann_whitney_counts(n, m) == tuple(found)


def test_wilcoxon_by_enumeration():
    n = 8
    sums = [sum(r for r, s in zip(range(1, n + 1), signs) if s) for signs in itertools.product((0, 1), repeat=n)]
    for w in (3, 10, 18, 30):
        p = 2 * min(sum(s <= w for s in sums), sum(s >= w for s in sums)) / 2**n
        assert exact.wilcoxon_p(w, n, 0) == pytest.approx(min(1, p))


def test_fisher_and_permutation():
    assert exact.fisher_p(1, 4, 5, 1) == pytest.approx(0.080087, abs=1e-5)
    x, y = np.array([1.0, 2, 3, 4]), np.array([10.0, 11, 12, 13])
    assert exact.permutation_p(x, y) == (pytest.approx(2 / math.comb(8, 4)), True)


def test_shapiro_on_published_weights():
    w, p = exact.shapiro([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236])
    assert w == pytest.approx(0.79, abs=0.01) and p == pytest.approx(0.007, abs=0.002)
    assert math.isnan(exact.shapiro([1, 1, 1])[0])


def test_sample_sizes():
    assert [power.least_n(lambda n, d=d: power.ttest_power(n, d), 0.8) for d in (0.8, 0.5, 0.2)] == [26, 64, 394]
    assert abs(power.least_n(lambda n: power.anova_power(n, 0.25, 3), 0.8) - 53) <= 1


def test_curve_recovers_parameters():
    shape, x = curves.SHAPES["logistic_growth"], np.linspace(0, 10, 40)
    y = shape.call(x, 8.0, 1.3, 4.5)
    p, _, cost = curves.least_squares(shape, x, y, shape.guess(x, y))
    assert p == pytest.approx([8.0, 1.3, 4.5], rel=1e-3) and cost < 1e-6


def test_transport_equals_sorted_matching_on_a_line():
    r = np.random.default_rng(2)
    for _ in range(20):
        x, y = np.sort(r.random(6)), np.sort(r.random(6))
        assert neighbours.transport(np.full(6, 1 / 6), np.full(6, 1 / 6), np.abs(x[:, None] - y)) == pytest.approx(np.abs(x - y).mean(), abs=1e-9)
    mass = np.array([0.5, 0.3, 0.2])
    assert neighbours.transport(mass, mass[::-1], np.abs(np.subtract.outer(np.arange(3), np.arange(3))).astype(float)) == pytest.approx(0.6)


def test_phages_amplify_and_cells_stay_positive():
    p, times = simulate.DEFAULTS | {"adsorption": 1e-8}, np.linspace(0, 6, 30)
    y = np.zeros(2 + 15)
    y[0], y[16] = 1e6, 1e5
    found = simulate.integrate("lytic", p, y, times)
    assert (found >= 0).all() and found[-1, 16] > 10 * y[16]
    alone = simulate.integrate("lytic", p, np.array([1e6] + [0.0] * 16), times)
    k, s = p["K"], 1e6
    logistic = k / (1 + (k / s - 1) * np.exp(-p["mu"] * times))
    assert alone[:, 0] == pytest.approx(logistic, rel=1e-2)


def test_extinction_theory_is_a_root():
    q = simulate.extinction_theory(50, 1e-3, 200, 0.05, 1)
    a = 0.2 / 0.25
    assert q == pytest.approx((1 - a) + a * q**50, abs=1e-9) and 0 < q < 1
    assert simulate.extinction_theory(1, 1e-3, 200, 0.05, 3) == 1.0


def test_wilcoxon_takes_counts_as_floats():
    from skerry.functions import exact

    assert exact.wilcoxon_p(0.0, 5.0, 0.0) == exact.wilcoxon_p(0, 5, 0) == 0.0625
    assert exact.mann_whitney_p(0.0, 3.0, 3.0, 0.0) == exact.mann_whitney_p(0, 3, 3, 0) == 0.1
