"""Nearest neighbours by pivots and components by a spanning forest, against plain loops."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skerry.operators import neighbours


def plain_nearest(rows, k):
    """{i: [(j, d)]} by comparing all rows."""
    kept = {}
    for key, v in rows:
        if key is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            kept[key] = min(kept.get(key, list(v)), list(v))
    dim = max((len(v) for v in kept.values()), default=0)
    unit = {}
    for key, v in kept.items():
        x = np.array([*v, *[0.0] * (dim - len(v))])
        unit[key] = x / np.linalg.norm(x) if np.linalg.norm(x) else x
    found = {}
    for i, x in unit.items():
        d = sorted((round(max(0.0, 1 - min(1.0, float(x @ y))), 12) if kept[i] != kept[j] or not x.any() else 0.0, j) for j, y in unit.items() if j != i)
        found[i] = [(j, dist) for dist, j in d[:k]]
    return found


@pytest.mark.parametrize("unit_rows", [4096, 40])
def test_nearest_equals_all_pairs(spark, monkeypatch, unit_rows):
    """Clusters, copies of one vector, zero and short vectors, odd rows; cells of one task and of several."""
    monkeypatch.setattr(neighbours, "UNIT_ROWS", unit_rows)
    monkeypatch.setattr(neighbours, "ROWS_PER_PIVOT", 50)
    r = np.random.default_rng(7)
    centres = r.normal(0, 1, (6, 5))
    rows = [(int(i), [float(x) for x in centres[i % 6] + r.normal(0, 0.2, 5)]) for i in range(500)]
    rows += [(1000 + i, rows[3][1]) for i in range(150)] + [(2000, [0.0] * 5), (2001, [0.0]), (2002, [1.0, 2.0]), (None, rows[1][1]), (3000, None), (3001, [float("nan")] * 5), (3002, [None] * 5), (7, rows[7][1]), (8, rows[9][1])]
    df = spark.createDataFrame(rows, "d long, x array<double>").withColumn("rank", F.lit("clash"))
    got = {}
    for e in neighbours.nearest(df, "d", "x", 4).collect():
        got.setdefault(e["i"], []).append((e["rank"], e["j"], e["d"]))
    want = plain_nearest(rows, 4)
    assert set(got) == set(want)
    for i, near in got.items():
        near = sorted(near)
        assert [x[0] for x in near] == [1, 2, 3, 4]
        assert [x[2] for x in near] == pytest.approx([d for _, d in want[i]], abs=1e-9)
        # keys decide between equal distances; those that differ by rounding only may swap
        assert [x[1] for x in near] == [j for j, _ in want[i]] or len({round(x[2], 9) for x in near}) < 4, (i, near, want[i])


def test_rows_without_near_cells_are_sent_once_a_shard(spark, monkeypatch):
    """Noise, of which every cell may hold a near row: what is sent grows with rows times shards, not times cells; small batches."""
    monkeypatch.setattr(neighbours, "ROWS_PER_PIVOT", 25)
    x = np.random.default_rng(3).normal(0, 1, (1500, 24))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "n long, v array<double>")
    sent, sort = [], type(df).sortWithinPartitions
    monkeypatch.setattr(type(df), "sortWithinPartitions", lambda self, *by: sent.append(self) or sort(self, *by))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = {}
        for e in neighbours.nearest(df, "n", "v", 3).orderBy("i", "rank").collect():
            got.setdefault(e["i"], []).append((e["j"], e["d"]))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = 1 - u @ u.T
    np.fill_diagonal(d, 9)
    assert [[j for j, _ in got[i]] for i in range(1500)] == np.argsort(d, axis=1)[:, :3].tolist()
    assert [[y for _, y in got[i]] for i in range(1500)] == [pytest.approx(r, abs=1e-12) for r in np.sort(d, axis=1)[:, :3]]
    assert sum(s.count() for s in sent) <= 1500 * (16 + 4)


def test_nearest_of_few_rows(spark):
    schema = "k string, x array<double>"
    assert neighbours.nearest(spark.createDataFrame([], schema), "k", "x", 3).count() == 0
    assert neighbours.nearest(spark.createDataFrame([("a", [1.0, 0.0])], schema), "k", "x", 3).count() == 0
    three = [("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [1.0, 0.0])]
    got = sorted(tuple(e) for e in neighbours.nearest(spark.createDataFrame(three, schema), "k", "x", 3).collect())
    assert got == [("a", "b", 1.0, 2), ("a", "c", 0.0, 1), ("b", "a", 1.0, 1), ("b", "c", 1.0, 2), ("c", "a", 0.0, 1), ("c", "b", 1.0, 2)]


def plain_components(nodes, edges):
    label = {n: n for n in nodes}
    while True:
        before = dict(label)
        for i, j in edges:
            label[i] = label[j] = min(label[i], label[j])
        if label == before:
            return label


def test_forest_and_components(spark):
    r = random.Random(4)
    edges = [(r.randrange(80), r.randrange(80), r.randint(1, 6)) for _ in range(75)] + [(200 + i, 201 + i, 2) for i in range(40)] + [(300, 300, 1), (5, 5, 1)]
    df = spark.createDataFrame(edges, "i long, j long, w int")
    forest = [tuple(e) for e in neighbours.spanning_forest(df).collect()]
    nodes = {x for i, j, _ in edges for x in (i, j)}
    for k in range(1, 7):
        among = [(i, j) for i, j, w in edges if w <= k]
        label = plain_components(nodes, among)
        assert len(set(label.values())) == len(nodes) - sum(w <= k for *_, w in forest)
    found = {x["node"]: x["label"] for x in neighbours.components(df).collect()}
    assert found == plain_components(nodes, [(i, j) for i, j, _ in edges])
    assert neighbours.spanning_forest(df.where("false")).count() == 0 and neighbours.components(df.where("false")).count() == 0


@pytest.mark.parametrize("mutual", [False, True])
def test_sweep(spark, mutual):
    r = np.random.default_rng(2)
    rows = [(i, [float(x) for x in r.normal(0, 1, 3) + 4 * (i % 3)]) for i in range(60)]
    near = neighbours.nearest(spark.createDataFrame(rows, "n long, v array<double>"), "n", "v", 9)
    listed = [tuple(e) for e in near.collect()]
    before, run, want = None, 0, []
    for k in range(2, 10):
        sides = {}
        for i, j, _, rank in listed:
            if rank <= k:
                sides[min(i, j), max(i, j)] = sides.get((min(i, j), max(i, j)), 0) + 1
        label = plain_components({i for i, *_ in listed}, [e for e, s in sides.items() if s == 2 or not mutual])
        run += before is not None and label != before
        want.append((k, len(set(label.values())), run))
        before = label
    got = sorted((x["k"], x["components"], x["run"], x["run_length"]) for x in neighbours.sweep_of(near, 2, 9, mutual).collect())
    assert [x[:3] for x in got] == want and all(x[3] == sum(w[2] == x[2] for w in want) for x in got)
    assert neighbours.sweep_of(near.where("false"), 2, 9).count() == 0
