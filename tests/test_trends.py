"""Trends by counting pairs: against lists of all pairs, by tasks and by blocks, with ties and hot values; exact quantiles."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skerry.functions import quantiles, trends
from skerry.operators import series
from skerry.plans import compare


def listed(points):
    """n, pairs, score and sorted slopes from all pairs."""
    points = [p for p in points if all(v is not None and np.isfinite(v) for v in p)]
    x, y = (np.array([p[i] for p in points], float) for i in (0, 1))
    i, j = np.triu_indices(len(x), 1)
    dx, dy = x[j] - x[i], y[j] - y[i]
    keep = dx != 0
    return len(x), int(keep.sum()), int(np.sign(dy[keep] * np.sign(dx[keep])).sum()), np.sort(dy[keep] / dx[keep])


def expected_variance(points):
    y = [p[1] for p in points if all(v is not None and np.isfinite(v) for v in p)]
    n, t = len(y), np.unique(y, return_counts=True)[1]
    return (n * (n - 1) * (2 * n + 5) - sum(int(c) * (int(c) - 1) * (2 * int(c) + 5) for c in t)) / 18


def cases():
    r = np.random.default_rng(5)
    n = 1500
    x = np.arange(n, dtype=float)
    made = {
        "rising": list(zip(x, 0.01 * x + r.normal(0, 3, n))),
        "rounded": list(zip(x, np.round(0.013 * x + r.normal(0, 3, n), 1))),
        "levels": list(zip(r.permutation(x), r.integers(0, 4, n).astype(float))),
        "repeated": list(zip(r.integers(0, 90, n).astype(float), r.normal(0, 1, n))),
        "hot": list(zip(np.where(r.random(n) < 0.5, 7.0, r.integers(0, 300, n)), np.where(r.random(n) < 0.4, 1.5, r.normal(0, 1, n)))),
        "one place": [(2.0, float(v)) for v in r.normal(0, 1, 600)],
        "flat": list(zip(x[:700], np.full(700, 3.25))),
        None: [(1.0, 2.0), (2.0, float("nan")), (3.0, 1.0), (3.0, 5.0), (4.0, None), (4.0, 4.0), (5.0, float("inf"))],
    }
    return made


@pytest.mark.parametrize("block", [65_536, 150])
def test_pair_counts_equal_lists_of_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(series, "BLOCK", block)
    monkeypatch.setattr(series, "SAMPLED", 300)
    made = cases()
    if block == 150:  # fewer searches, the same kinds of series
        made = {k: v for k, v in made.items() if k in ("rounded", "hot", "one place", None)}
    rows = [(k, None if x is None else float(x), None if y is None else float(y)) for k, points in made.items() for x, y in points]
    random.Random(1).shuffle(rows)
    # names that clash with columns of the work
    df = spark.createDataFrame(rows, "n string, slope double, y double")
    got = {r["n"]: r for r in series.pair_counts(df, "slope", "y", ["n"]).withColumnRenamed("_n", "size").collect()}
    assert set(got) == set(made)
    for k, points in made.items():
        n, pairs, score, slopes = listed(points)
        g = got[k]
        assert (g["size"], g["_pairs"], g["_score"]) == (n, pairs, score), k
        assert g["_variance"] == pytest.approx(expected_variance(points))
        if pairs:
            want = [slopes[i - 1] for i in series._ranks(pairs, g["_variance"])]
            assert g["_slopes"] == pytest.approx(want, rel=1e-9, abs=1e-9), k


def test_trend_of_null_and_clashing_keys(spark):
    rows = [(k, float(i), float(i * (2 if k else -3))) for k in ("a", None) for i in range(12)] + [("short", 1.0, 2.0)]
    df = spark.createDataFrame(rows, "score string, z double, variance double")
    got = {r[0]: r for r in compare.trend_test(df, "z", "variance", ["score"]).collect()}
    assert set(got) == {"a", None} and got["a"]["direction"] == "increasing" and got[None]["direction"] == "decreasing"
    assert (got["a"]["slope"], got[None]["slope"], got[None]["intercept"], got["a"]["low"]) == (2.0, -3.0, 0.0, 2.0)
    assert series.theil_sen(df, "z", "variance", ["score"]).count() == 2 and series.mann_kendall(df, "z", "variance", ["score"]).count() == 2
    assert series.theil_sen(df, "z", "variance", []).count() == 1
    assert compare.trend_test(df.where("false"), "z", "variance", ["score"]).count() == 0


def test_series_of_a_million_points(spark):
    """Score by blocks equals the count in one array."""
    n = 1_000_000
    df = spark.range(n).select(F.lit("s").alias("k"), F.col("id").cast("double").alias("t"), (F.pmod(F.xxhash64("id"), F.lit(100_000)) + F.col("id") / 50).alias("v"))
    got = series.mann_kendall(df, "t", "v", ["k"]).first()
    v = np.array([r[0] for r in df.orderBy("t").select("v").toPandas().itertuples(index=False)])
    pairs, under = n * (n - 1) // 2, trends.discordant(np.arange(n, dtype=float), v)
    assert got["score"] == pairs - trends.tied_pairs(v) - 2 * under and got["n"] == n


def test_selection_by_counting():
    r = np.random.default_rng(3)
    for n, whole in ((2, False), (50, True), (513, False), (900, True)):
        x = np.sort(r.integers(0, max(2, n // 2), n).astype(float)) if whole else np.arange(n, dtype=float)
        y = np.round(0.3 * x + r.normal(0, 5, n), 1 if whole else 12)
        _, pairs, _, slopes = listed(list(zip(x, y)))
        ranks = sorted({1, pairs, pairs // 3 or 1, (pairs + 1) // 2})
        assert trends.select(x, y, ranks) == pytest.approx([slopes[k - 1] for k in ranks], rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("held", [200_000, 20])
def test_quantiles(spark, monkeypatch, held):
    monkeypatch.setattr(quantiles, "HELD", held)
    r = random.Random(8)
    data = {"hot": [r.choice([1.0, 2.5, r.gauss(0, 9)]) for _ in range(900)], "one": [4.0], None: [float(i) for i in range(30)], "same": [3.0] * 50}
    rows = [(k, v) for k, vs in data.items() for v in [*vs, None]]
    r.shuffle(rows)
    shares = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {x["q"]: x["found"] for x in quantiles.quantiles(spark.createDataFrame(rows, "q string, v double").repartition(5), ["q"], "v", shares, "found").collect()}
    assert set(got) == set(data)
    for k, vs in data.items():
        assert got[k] == pytest.approx(list(np.quantile(vs, shares)), abs=1e-12)
    assert quantiles.quantiles(spark.createDataFrame([], "q string, v double"), ["q"], "v", shares).count() == 0
