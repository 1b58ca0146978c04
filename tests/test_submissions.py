"""Flags of submissions: what stood in the logs at the time, null keys, unknown transcripts, empty logs."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from skerry.functions import columns
from skerry.operators import submissions

DAY = [datetime(2026, 5, 1) + timedelta(days=i) for i in range(12)]
TESTS = "transcript_id string, data_id string, at timestamp, p_value double, error string, stability string, verified boolean"
LOGS = {"numbers": "transcript_id string, number double", "exclusions": "data_id string, at timestamp, justification string", "predictions": "data_id string, created_at timestamp, prediction string"}


def frames(spark, tests, submitted, **logs):
    made = {k: spark.createDataFrame(logs.get(k, []), schema) for k, schema in LOGS.items()}
    return {"tests": spark.createDataFrame(tests, TESTS), "submissions": spark.createDataFrame(submitted, "item_id long, claim string, transcript_ids array<string>, submitted_at timestamp")} | made


def test_flags(spark):
    tests = [("t1", "a", DAY[1], 0.2, None, None, True), ("t2", "a", DAY[2], 0.3, None, "warn", None), ("t3", "a", DAY[3], None, "failed", None, None), ("t4", "a", DAY[4], 0.01, None, None, False), ("t5", "b", DAY[5], 0.5, None, "ok", None), ("t6", None, DAY[5], 0.5, None, None, None)]
    submitted = [(1, "p = 0.2 here", ["t1", "t1", "gone", None], DAY[6]), (2, "p = 0.01 and p = 0.9", ["t2", "t4"], DAY[6]), (3, None, ["t5", "t6"], DAY[6]), (4, "a mean of 4.5", None, DAY[6]), (5, "", [], None)]
    logs = {
        "numbers": [("t1", 0.2), ("t2", 0.3), ("t4", 0.01)],
        "exclusions": [("a", DAY[1], "it spoils the result"), ("a", DAY[9], "it spoils the result"), ("b", DAY[1], "the tube cracked"), (None, DAY[1], "")],
        "predictions": [("a", DAY[2], "more"), ("a", DAY[3], "less"), ("b", DAY[7], "late"), (None, DAY[1], "x")],
    }
    data = frames(spark, tests, submitted, **logs)
    got = {(r["item_id"], r["kind"], r["severity"], r["transcript_id"], r["data_id"]) for r in submissions.flags(**data).collect()}
    assert got == {
        (2, "stability", "warn", "t2", None), (2, "verification_mismatch", "block", "t4", None), (2, "multiple_comparisons", "warn", "t4", None), (2, "unverified_number_in_claim", "block", None, None),
        (1, "no_prediction", "warn", None, "a"), (3, "no_prediction", "warn", None, "b"), (1, "exclusion_justified_by_result", "block", None, "a"), (2, "exclusion_justified_by_result", "block", None, "a"), (4, "unverified_number_in_claim", "block", None, None),
    }
    seen = {r["transcript_id"]: (r["test_no"], r["prediction"], r["amendments"]) for r in submissions.history(data["tests"], data["predictions"]).collect()}
    assert seen == {"t1": (1, None, 0), "t2": (2, "more", 0), "t3": (2, "less", 1), "t4": (3, "less", 1), "t5": (1, None, 0), "t6": (0, None, 0)}
    queue = {r["item_id"]: (r["flags"], r["worst"]) for r in submissions.queue(data["submissions"], submissions.flags(**data)).collect()}
    assert queue == {1: (2, "block"), 2: (5, "block"), 3: (1, "warn"), 4: (1, "block"), 5: (0, None)}


def test_gate_and_empty_logs(spark):
    asked = spark.createDataFrame([("a", DAY[1]), ("a", DAY[3]), (None, DAY[3])], "data_id string, at timestamp")
    notes = spark.createDataFrame([("a", DAY[2], "more"), (None, DAY[1], "more")], LOGS["predictions"])
    assert sorted((r["data_id"] or "", r["at"], r["allowed"]) for r in submissions.gate(asked, notes).collect()) == [("", DAY[3], False), ("a", DAY[1], False), ("a", DAY[3], True)]
    assert submissions.flags(**frames(spark, [], [])).count() == 0
    assert submissions.queue(**{"items": spark.createDataFrame([], "item_id long"), "flagged": submissions.flags(**frames(spark, [], []))}).count() == 0


def test_children(spark):
    rows = spark.createDataFrame([(p, k, DAY[k % 5]) for p in ("x", "y", None) for k in range(12)], "w string, k long, at timestamp")
    got = submissions.children(spark.createDataFrame([("x",), ("x",), ("z",), (None,)], "w string"), rows, "w", "k", "at", page=3)
    assert [(r["w"], r["k"], r["place"], r["n"]) for r in got.orderBy("place").collect()] == [("x", 9, 1, 12), ("x", 4, 2, 12), ("x", 8, 3, 12)]
    assert got.where(F.col("place") > 3).count() == 0


def test_history_orders_its_rows_once(spark, monkeypatch):
    """Tests and predictions are written in ranges once, and no row is shuffled to meet what stands in other ranges."""
    plain, tables = columns.written, []
    monkeypatch.setattr(columns, "written", lambda df, name: tables.append(name) or plain(df, name))
    tests = [(f"t{i:03}", None if i % 7 == 0 else "hot" if i % 3 else f"d{i % 5}", DAY[i * 5 % 12], 0.1 if i % 4 else None, None, None, None) for i in range(400)]
    notes = [(None if i % 9 == 0 else "hot" if i % 2 else f"d{i % 5}", DAY[i * 7 % 12], f"p{i}") for i in range(1, 40)]
    data = frames(spark, tests, [], predictions=notes)
    seen = submissions.history(data["tests"], data["predictions"])
    assert tables == ["ranges"]
    got = {r["transcript_id"]: (r["test_no"], r["prediction"] is None, r["amendments"]) for r in seen.collect()}
    plan = seen._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan

    def told(name, of, at):
        no = sum(p is not None and d == of and (t, n) <= (at, name) for n, d, t, p, *_ in tests) if of else 0
        by = sum(d == of and t <= at for d, t, _ in notes) if of else 0
        return no, by == 0, max(by - 1, 0)

    assert got == {n: told(n, d, t) for n, d, t, *_ in tests}
