"""Validation without rules, hints, and uploads that are kept once with their report."""

import pytest
from pyspark.sql import functions as F

from skerry.operators import validate
from skerry.operators.validate import Rule
from skerry.plans.uploads import Uploads


def test_mixed_columns_and_hints(spark):
    rows = [(i, str(i) if i % 5 else "none yet", "a" if i % 2 else "b", str(i)) for i in range(40)] + [(40, None, None, "7 C")]
    df = spark.createDataFrame(rows, "row long, reeding string, kind string, value string")
    got = [tuple(r) for r in validate.validate(df, "row").collect()]
    assert sorted(r[1] for r in got) == [2, 7, 12, 17, 22] and {r[::2] for r in got} == {("block", "reeding", "80 % of this column are numbers")}
    ruled = {(r["column_name"], r["rule"]): r["hint"] for r in validate.validate(df, "row", [Rule("reading"), Rule("kind", "text", allowed=("a",)), Rule("value", most=38)]).collect()}
    assert ruled["reading", "missing_column"] == "is it reeding?" and ruled["value", "above_maximum"] == "at most 38.0" and ruled["kind", "not_allowed"] == "one of a" and ruled["reeding", "extra_column"] is None
    assert [tuple(r) for r in validate.validate(df.where("false"), "row").collect()] == [("warn", None, None, "too_few_rows", "at least 3")]
    inferred = {r["column_name"]: (r["kind"], r["allowed"]) for r in validate.infer(df, "row").collect()}
    assert inferred == {"reeding": ("text", None), "kind": ("category", ["a", "b"]), "value": ("integer", None)}


def test_uploads(spark, tmp_path):
    store = Uploads(spark, str(tmp_path / "store"))
    good = spark.createDataFrame([("x", 1.0), ("y", 2.0), ("z", 3.0)], "sample string, reading double")
    rules = [Rule("sample", "text"), Rule("reading", most=5)]
    store.put("one", good, rules)
    store.put("one", good.repartition(2), rules)
    store.put("bad", good.withColumn("reading", F.col("reading") * 3), rules)
    store.put("none", good.where("false"), rules)
    register = {r["dataset_id"]: (r["rows"], r["blocks"], r["valid"]) for r in store.register().collect()}
    assert register == {"one": (3, 0, True), "bad": (3, 2, False), "none": (0, 0, True)}
    assert store.rows("bad").count() == 3 and {r["rule"] for r in store.issues("bad").collect()} == {"above_maximum"}
    assert spark.read.parquet(str(tmp_path / "store" / "register")).count() == 3
    assert sorted(r["row_index"] for r in store.rows("one").collect()) == [0, 1, 2]
    with pytest.raises(ValueError, match="letters"):
        store.put("../x", good)


def test_repeated_batches_leave_no_double_rows(spark, tmp_path):
    store = Uploads(spark, str(tmp_path / "store"))
    source = str(tmp_path / "in")
    for i in range(2):
        spark.createDataFrame([(f"s{i}", float(j)) for j in range(4)], "sample string, reading double").coalesce(1).write.mode("append").parquet(source)
    keep = store.each_batch("batch")
    seen = []

    def twice(batch, number):
        keep(batch, number)
        keep(batch, number)  # as after a failure between the write and the commit of the stream
        seen.append(number)

    stream = spark.readStream.schema("sample string, reading double").option("maxFilesPerTrigger", 1).parquet(source)
    stream.writeStream.foreachBatch(twice).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(seen) == [0, 1]
    assert sum(store.rows(f"batch-{i}").count() for i in seen) == 8 and spark.read.parquet(str(tmp_path / "store" / "register")).count() == 2
