"""Rarefaction against subsets drawn in all ways, its band, and saturation."""

import itertools

import numpy as np
import pytest

from skerry.operators import diversity


def all_subsets(counts, depth):
    """Mean and deviation of the taxa in every subset of so many individuals."""
    pool = [t for t, n in enumerate(counts) for _ in range(n)]
    found = [len({pool[i] for i in s}) for s in itertools.combinations(range(len(pool)), depth)]
    return float(np.mean(found)), float(np.std(found))


@pytest.mark.parametrize("most", [4_000_000, 0])
def test_rarefaction_equals_all_subsets(spark, monkeypatch, most):
    """Equal and different abundances, repeated and odd rows, a null sample; products and log-gamma alike."""
    monkeypatch.setattr(diversity, "MOST_FACTORS", most)
    samples = {"a": [5, 3, 3, 1, 1, 1], "one": [4], None: [2, 2, 2, 2]}
    rows = [(s, f"t{i}", n) for s, counts in samples.items() for i, n in enumerate(counts)]
    rows = [(s, t, n - 1) if n > 1 else (s, t, n) for s, t, n in rows] + [(s, t, 1) for s, t, n in rows if n > 1]
    rows += [("a", "none", 0), ("a", "null", None), ("empty", "t", 0)]
    df = spark.createDataFrame(rows, "sample string, taxon string, n long")
    got = diversity.rarefaction(df, 6).collect()
    assert {r["sample"] for r in got} == set(samples)
    for r in got:
        mean, sd = all_subsets(samples[r["sample"]], r["depth"])
        assert r["expected"] == pytest.approx(mean, abs=1e-9) and r["sd"] == pytest.approx(sd, abs=1e-6)
        assert r["low"] <= r["expected"] <= r["high"]
    assert diversity.rarefaction(df.where("false")).count() == 0


def test_saturation(spark):
    rows = [("flat", f"t{i}", 200) for i in range(5)] + [("rising", f"t{i}", 1) for i in range(400)] + [("single", "t", 1)]
    curve = diversity.rarefaction(spark.createDataFrame(rows, "sample string, taxon string, n long"))
    assert {r["sample"]: r["saturated"] for r in diversity.saturation(curve).collect()} == {"flat": True, "rising": False}
