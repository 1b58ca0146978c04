"""Guards of turns: the table against a plain loop, the stream against the table, with late and repeated events."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from skerry.streaming import ledgers, turns

SCHEMA = "conv_id string, seq long, at timestamp, kind string, message string, reply string, numbers array<double>, data_id string, p_value double"
START = datetime(2026, 3, 1, tzinfo=timezone.utc)


def conversations(n=12, seed=3):
    r, rows = random.Random(seed), []
    messages = ["compare both ponds", "please plot it", "leave out that point", "is it significant?", None, "mail me at a.b@c.de"]
    for c in range(n):
        at, numbers = START + timedelta(minutes=c), []
        for seq in range(r.randint(1, 30)):
            at += timedelta(seconds=r.randint(1, 40))
            kind = r.choice(["result", "result", "turn", "turn", "prediction"])
            data = r.choice(["d1", "d1", "d2", None])
            values = [round(r.uniform(0, 3), 3) for _ in range(2)] if kind == "result" else None
            numbers += values or []
            quoted = r.choice(numbers) if numbers and r.random() < 0.7 else 77.125
            reply = r.choice([f"The mean is {quoted:.2f}.", f"d = {quoted}", "Nothing to report.", None, "p = 0.3, which proves there is no effect."]) if kind == "turn" else None
            rows.append((f"c{c}", seq, at, kind, r.choice(messages) if kind == "turn" else None, reply, values, data, r.choice([None, 0.04]) if kind == "result" else None))
    return rows


def plain(rows):
    """Turns judged one by one, from the phrases and numbers that the guards find."""
    found, state = [], {}
    for conv, seq, at, kind, message, reply, numbers, data, p in sorted({(r[0], r[1]): r for r in rows}.values(), key=lambda r: (r[0] or "", r[1])):
        s = state.setdefault(conv, {"known": [], "tests": {}, "predicted": set()})
        if kind == "result":
            s["known"] += numbers
            if p is not None and data is not None:
                s["tests"][data] = s["tests"].get(data, 0) + 1
        elif kind == "prediction":
            s["predicted"].add(data)
        else:
            reasons = ["specification_search"] if message == "leave out that point" else []
            if reply and "proves" in reply:
                reasons.append("unsupported_claim")
            if message in ("compare both ponds", "is it significant?") and data is not None and data not in s["predicted"]:
                reasons.append("no_prediction")
            off = sum(not any(abs(v - n) <= 0.5 * 10**-places + 1e-6 for v in s["known"]) for *_, n, places in turns.guards.claims_of(reply or ""))
            if off:
                reasons.append("unverified_number")
            tests = s["tests"].get(data, 0)
            found.append((conv, seq, "mail me at [EMAIL]" if message and "@" in message else message, sorted(reasons), off, tests, tests >= 3))
            s["known"] = []
    return sorted(found, key=repr)


def test_table_equals_a_plain_loop(spark):
    rows = conversations()
    rows += rows[5:60:7] + [(None, 0, START, "turn", "is it significant?", "d = 2", None, "d1", None)]
    got = turns.judged(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, got), key=repr) == plain(rows)
    assert turns.judged(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(name, before)


def test_stream_equals_table(spark, tmp_path, rocks):
    """Batches overlap in time: events arrive up to some minutes late, some twice, also in another batch."""
    r, rows = random.Random(9), conversations(8, seed=5)
    arrived = sorted(rows, key=lambda x: x[2] + timedelta(seconds=r.randint(0, 400)))
    batches = [arrived[i : i + 40] for i in range(0, len(arrived), 40)]
    for a, b in zip(batches, batches[1:]):
        b += r.sample(a, 5) + r.sample(b, 3)
    # an event far ahead moves the watermark past all others
    batches.append([("last", 0, START + timedelta(days=1), "turn", None, None, None, None, None)])
    folder = str(tmp_path / "events")
    for b in batches:
        spark.createDataFrame(b, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    stream = turns.judged_stream(ledgers.follow(spark, folder, spark.createDataFrame([], SCHEMA).schema, files_per_batch=1))
    query = stream.writeStream.format("memory").queryName("judged_turns").option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
    query.awaitTermination(300)
    got = spark.table("judged_turns").where(F.col("conv_id") != "last").collect()
    assert sorted(map(tuple, got), key=repr) == plain(rows) and len(got) > 20
