"""Intervals of plate counts."""

import pandas as pd

from skerry.functions import special
from skerry.operators import lab


def test_equal_counts_are_worked_out_once(monkeypatch):
    seen, exact = [], special.poisson_interval
    monkeypatch.setattr(special, "poisson_interval", lambda n: seen.append(n) or exact(n))
    got = lab._intervals(pd.Series([3, 0, 3, 3]))
    assert sorted(seen) == [0, 3] and list(got.itertuples(index=False, name=None)) == [exact(n) for n in (3, 0, 3, 3)]


def test_titre_of_a_table(spark):
    rows = spark.createDataFrame([(n, 10.0, 0.1) for n in (0, 40, 40)], "plaques long, dilution double, volume double")
    got = lab.titre(rows, "plaques", "dilution", "volume").collect()
    assert all(r["low"] / 100 == special.poisson_interval(r["plaques"])[0] or abs(r["low"] / 100 - special.poisson_interval(r["plaques"])[0]) < 1e-9 for r in got) and len(got) == 3
