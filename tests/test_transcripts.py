"""Records of calls, walks over results of any shape, as-of joins and running values over ranges."""

import json
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from skerry.functions.columns import as_of, running
from skerry.plans import transcripts
from skerry.plans.transcripts import TranscriptStore


def walked(value, path="$"):
    """All numbers of a nested value with their paths, by plain recursion."""
    if isinstance(value, bool) or value is None:
        return []
    if isinstance(value, (int, float)):
        return [(path, float(value))] if math.isfinite(value) else []
    if isinstance(value, str):
        return [(path, float(m)) for m in re.findall(r"[-+]?\d*\.?\d+(?:[eE][-+]?\d+)?", value.replace(",", "")) if math.isfinite(float(m))]
    if isinstance(value, dict):
        return [x for k, v in value.items() for x in walked(v, f"{path}.{k}" if re.fullmatch(r"\w+", k, re.ASCII) else f'{path}."{k}"')]
    return [x for i, v in enumerate(value) for x in walked(v, f"{path}[{i}]")]


def nested(r, depth):
    kind = r.randrange(9 if depth else 6)
    if kind == 0:
        return r.choice([True, False, None])
    if kind == 1:
        return r.randint(-(10**9), 10**9)
    if kind == 2:
        return r.uniform(-1, 1) * 10 ** r.randint(-8, 12)
    if kind in (3, 4, 5):
        return r.choice(["none here", "95% CI 0.12 to .45", "1,234 of 2e3 rows, -7", "", "x=1.5.2"])
    if kind == 6:
        return [nested(r, depth - 1) for _ in range(r.randrange(4))]
    return {r.choice(["a", "b_1", "p value", "é", "n"]) + str(i): nested(r, depth - 1) for i in range(r.randrange(4))}


def test_numbers_of_any_shape(spark):
    r = random.Random(4)
    values = {f"t{i}": nested(r, 4) for i in range(300)}
    values |= {"deep": {"a": [[[{"b": [{"c": {"d": 0.25}}]}]]]}, "flat": 3, "empty": {}, "none": []}
    rows = [(k, json.dumps(v)) for k, v in values.items()] + [("broken", "p = .05, not {json"), ("null", None), (None, "7")]
    got = transcripts.numbers(spark.createDataFrame(rows, "transcript_id string, result string")).collect()
    want = [(k, *x) for k, v in values.items() for x in walked(v)] + [("broken", "$[0]", 0.05), (None, "$", 7.0)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert transcripts.numbers(spark.createDataFrame([], "transcript_id string, result string")).count() == 0


def test_calls_are_recorded(spark, tmp_path):
    store = TranscriptStore(spark, str(tmp_path / "store"))
    rows = [("a", 1.0), ("a", 2.0), ("a", 4.0), ("b", 8.0), ("b", float("nan")), ("b", 9.5)]
    df = spark.createDataFrame(rows, "g string, v double")
    first = store.run("describe", df=df, group="g", value="v")
    assert sorted((r["group_label"], r["n"], r["mean"]) for r in first.value.collect()) == [("a", 3, 7 / 3), ("b", 2, 8.75)]
    marker = store.marker()
    with pytest.raises(ValueError, match="justification"):
        store.run("compare_groups", df=df, group="g", value="v")
    second = store.run("compare_groups", justification="asked before measuring", df=df.repartition(3), group="g", value="v")
    calls = {r["transcript_id"]: r for r in store.calls().collect()}
    assert len(calls) == 3 and store.since(marker).count() == 2
    one, two = calls[first.transcript_id], calls[second.transcript_id]
    assert one["call"] == 'describe(df=<g, v>, group="g", value="v")' and one["error"] is None and one["duration_ms"] >= 0
    assert one["data_id"] == two["data_id"] and json.loads(one["engine"])["spark"] and json.loads(two["params"])["justification"] == "asked before measuring"
    failed = next(r for r in calls.values() if r["error"])
    assert failed["error"].startswith("ValueError: compare_groups needs") and failed["data_id"] == one["data_id"] and store.results().where(F.col("transcript_id") == failed["transcript_id"]).count() == 0
    found = {(r["path"], r["number"]) for r in store.numbers().collect() if r["transcript_id"] == first.transcript_id}
    assert {("$.mean", 8.75), ("$.n", 3.0), ("$.maximum", 9.5)} <= found
    assert {r["transcript_id"] for r in store.numbers(marker).select("transcript_id").distinct().collect()} == {second.transcript_id}
    store.put(store.get(first.transcript_id))
    store.put(store.get(first.transcript_id).withColumn("transcript_id", F.lit("tx_other")))
    assert store.calls().count() == 4 and store.get("nothing").count() == 0
    assert store.inferential_on(None).count() == 0


def test_inferential_calls(spark, tmp_path):
    store = TranscriptStore(spark, str(tmp_path / "s"))
    df = spark.createDataFrame([(g, float(i * i % 17 + 5 * g)) for g in (0, 1) for i in range(12)], "g int, v double")
    done = store.run("compare_groups", justification="planned", df=df, group="g", value="v")
    store.run("describe", df=df, group="g", value="v")
    data_id = store.get(done.transcript_id).first()["data_id"]
    assert [(r["transcript_id"], r["p_value"]) for r in store.inferential_on(data_id).collect()] == [(done.transcript_id, done.value.first()["p_value"])]


def test_canonical_forms():
    import numpy as np

    assert transcripts.canonical({"a": np.array([1.5, 2]), "n": np.int64(3), "x": float("nan"), "t": (1, "b", None)}) == {"a": [1.5, 2.0], "n": 3, "x": "nan", "t": [1, "b", None]}
    long = transcripts.canonical(list(range(100)))
    assert long == transcripts.canonical([float(i) for i in range(100)]) and long["list"] == 100 and long != transcripts.canonical(list(range(99)))
    assert transcripts.canonical(list("ab" * 50)) == list("ab" * 50)


def test_running_values(spark):
    """One hot key, a null one, several columns at once; sums and latest values equal a plain loop on every partitioning."""
    r = random.Random(2)
    rows = [(r.choice(["hot", "hot", "x", None]), i, r.choice([None, float(r.randint(-5, 9))])) for i in range(2000)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, i long, v double").repartition(7)
    got = {x["i"]: (x["s"], x["last"]) for x in running(df, ["k"], ["i"], s=("sum", F.col("v")), last=("last", F.col("v"))).collect()}
    state = {}
    for k, i, v in sorted(rows, key=lambda x: x[1]):
        s, last = state.get(k, (None, None))
        state[k] = s, last = (s if v is None else (s or 0.0) + v), (last if v is None else v)
        assert got[i] == (s, last)
    assert running(df.where("false"), ["k"], ["i"], s=("sum", F.col("v"))).count() == 0
    assert running(df, [], ["i"], s=("sum", F.lit(1))).agg(F.max("s")).first()[0] == 2000


def test_as_of(spark):
    r = random.Random(6)
    tests = [(r.choice(["a", "b", None]), r.choice([None, r.randint(0, 40)]), i) for i in range(120)]
    notes = [(r.choice(["a", "b", "c", None]), r.choice([None, r.randint(0, 40)]), f"n{i}", r.randint(1, 3)) for i in range(60)]
    left = spark.createDataFrame(tests, "d string, at long, i long")
    right = spark.createDataFrame(notes, "d string, written long, note string, n long")
    got = as_of(left, right, ["d"], "at", "written", note=("last", "note"), total=("sum", "n")).collect()
    assert len(got) == len(tests)
    for x in got:
        earlier = [m for m in notes if m[0] == x["d"] and m[1] is not None and x["at"] is not None and m[1] <= x["at"]]
        assert x["total"] == (sum(m[3] for m in earlier) or None)
        latest = {m[2] for m in earlier if m[1] == max(e[1] for e in earlier)}
        assert x["note"] in latest if latest else x["note"] is None
