"""Draws of many observations at once, against md5 of each and against the plain definition of the resamplings."""

import hashlib

import numpy as np
import pytest

from skerry.functions.draws import digests
from skerry.operators import resample, robust


def number(*parts):
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:8], 16)


@pytest.mark.parametrize("prefix", ["20260901|7|", "20260901|12|a group|", "x" * 44, "é" * 40])
def test_digests_equal_hashlib(prefix):
    numbers = np.array([0, 9, 10, 99, 100, 12345, 10**9])
    for _, at, words in digests(numbers, [prefix]):
        for n, row in zip(numbers[at], np.stack(words, axis=1)):
            assert "".join(f"{w:08x}" for w in row) == hashlib.md5(f"{prefix}{n}".encode()).hexdigest()


@pytest.fixture(scope="module")
def rows(spark):
    values = [(i, "a" if i % 3 else "b", None if i == 5 else float(i * i % 17)) for i in range(40)]
    return spark.createDataFrame(values, "idx int, g string, v double").persist()


@pytest.mark.parametrize("held", [1_000_000, 0])
def test_bootstrap_draws_are_no_side_that_is_broadcast(spark, rows, monkeypatch, held):
    """Sums in tasks or a shuffled join; before, the planner took the draws for the small side of a broadcast."""
    monkeypatch.setattr(resample, "HELD", held)
    v = [r["v"] for r in rows.orderBy("idx").collect()]
    found = resample.bootstrap(rows, "v", 30)
    assert "explode" not in found._jdf.queryExecution().toString().lower()
    for r in found.collect():
        drawn = [v[number(resample.SEED, r["replicate"], i) % 40] for i in range(40)]
        assert r["statistic"] == pytest.approx(np.mean([x for x in drawn if x is not None]))


@pytest.mark.parametrize("reach", [6.0, 0.0])
@pytest.mark.parametrize("name", ["mean_difference", "median_difference", "ratio_of_means"])
def test_shuffles_by_their_cut(spark, rows, monkeypatch, reach, name):
    """Only hashes near the cut are put in order; a replicate whose cut lies elsewhere is put in order whole."""
    monkeypatch.setattr(resample, "REACH", reach)
    data = [(r["idx"], r["g"], r["v"]) for r in rows.collect()]
    n_a = sum(g == "a" for _, g, _ in data)
    of = {"mean_difference": lambda p, q: np.nanmean(p) - np.nanmean(q), "median_difference": lambda p, q: np.nanmedian(p) - np.nanmedian(q), "ratio_of_means": lambda p, q: np.nanmean(p) / np.nanmean(q)}[name]
    side = lambda pairs: np.array([np.nan if v is None else v for _, _, v in pairs])
    observed, centre, extreme = of(side([d for d in data if d[1] == "a"]), side([d for d in data if d[1] == "b"])), float(name == "ratio_of_means"), 0
    for r in range(25):
        order = sorted(data, key=lambda d: hashlib.md5(f"{resample.SEED}|{r}|{d[0]}".encode()).hexdigest())
        extreme += abs(of(side(order[:n_a]), side(order[n_a:])) - centre) >= abs(observed - centre) - 1e-9
    got = resample.shuffle_test(rows, "g", "v", "a", "b", 25, name=name).first()
    assert got["observed"] == pytest.approx(observed) and got["p_value"] == pytest.approx((extreme + 1) / 26)


@pytest.mark.parametrize("held", [1_000_000, 0])
def test_redrawn_groups(spark, rows, monkeypatch, held):
    monkeypatch.setattr(robust, "HELD", held)
    own = {g: [r["v"] for r in rows.where(f"g = '{g}'").orderBy("idx").collect()] for g in "ab"}
    found = robust.redrawn(rows.unionByName(spark.createDataFrame([(40, None, 1.0)], rows.schema)), "g", "v", 12).collect()
    assert len(found) == 24
    for r in found:
        v = own[r["group_label"]]
        drawn = [v[number(resample.SEED, r["replicate"], r["group_label"], i) % len(v)] for i in range(len(v))]
        assert r["n"] == len(v) and r["s"] == pytest.approx(sum(x for x in drawn if x is not None)) and r["q"] == pytest.approx(sum(x * x for x in drawn if x is not None))


def test_one_sample_draws_from_all_finite_values(spark, rows):
    """Left-out rows leave no gaps in the index: before, the last values were never drawn."""
    gaps = spark.createDataFrame([(i, None if i < 20 else 0.0 if i < 39 else 1000.0) for i in range(40)], "idx int, v double")
    assert robust.one_sample(gaps, "v", 0.0, 400).first()["high"] > 0


def test_stability_keeps_its_verdict(spark, rows):
    got = robust.stability(rows, "g", "v", 20).first()
    assert got["redrawn"] == 20 and 0 <= got["agreement"] <= 1
