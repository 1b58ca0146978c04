"""What a reviewer should see of submitted work, derived from the record and not from what the author says.

Tests, predictions and exclusions are logs with times.  Each test is seen with what stood in the logs when it was run:
the latest prediction before it, how many tests its data had had.  A submission is seen with the exclusions up to its time.

Defined cases: tests with an error or without a p-value are not counted; a null data_id has no ledger, prediction or
exclusions; a prediction at the very time of a test is in time; unknown transcripts are ignored, repeated ones of an item
count once; a submission without transcripts can only have unverified numbers, a null claim has none; empty logs
mean that nothing was written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skerry.functions.columns import as_of
from skerry.operators import governance, guards

#: From so many tests of the same data on, a reviewer is told.
MANY_TESTS = 3
FLAGS = "item_id, kind, severity, transcript_id, data_id, detail"


def history(tests: DataFrame, predictions: DataFrame) -> DataFrame:
    """``tests`` (transcript_id, data_id, at, p_value, error, ...) with ``test_no``, how many of its data up to it, and the prediction then in force.

    A prediction is in force in its latest version before the test; ``amendments`` counts the versions before that one.
    """
    counted = (F.col("error").isNull() & F.col("p_value").isNotNull() & F.col("data_id").isNotNull()).cast("long")
    notes = predictions.where("data_id is not null").select("data_id", "created_at", "prediction", F.lit(1).alias("_one"))
    # tests and predictions are put in order once, for both
    seen = as_of(tests, notes, ["data_id"], "at", "created_at", ["transcript_id"], {"test_no": ("sum", counted)}, prediction=("last", "prediction"), _versions=("sum", "_one"))
    return seen.withColumn("amendments", F.greatest(F.coalesce("_versions", F.lit(0)) - 1, F.lit(0))).drop("_versions")


def gate(requests: DataFrame, predictions: DataFrame) -> DataFrame:
    """``requests`` (data_id, at, ...) with ``allowed``: a prediction for the data was written by then."""
    notes = predictions.where("data_id is not null and prediction is not null").select("data_id", "created_at", "prediction")
    seen = as_of(requests, notes, ["data_id"], "at", "created_at", prediction=("last", "prediction"))
    return seen.withColumn("allowed", F.col("prediction").isNotNull())


def flags(submissions: DataFrame, tests: DataFrame, numbers: DataFrame, exclusions: DataFrame, predictions: DataFrame) -> DataFrame:
    """(item_id, kind, severity, transcript_id, data_id, detail) of ``submissions`` (item_id, claim, transcript_ids, submitted_at).

    ``tests`` has transcript_id, data_id, at, p_value, error, stability (a severity or null) and verified (null: not
    tried); ``numbers`` (transcript_id, number) is what the transcripts hold; ``exclusions`` has data_id, at and justification,
    ``predictions`` data_id, created_at and prediction.
    """
    listed = submissions.select("item_id", "submitted_at", F.explode(F.array_distinct("transcript_ids")).alias("transcript_id")).where("transcript_id is not null")
    mine = listed.join(history(tests, predictions), "transcript_id")
    none = F.lit(None).cast("string")

    def told(rows: DataFrame, kind: str, severity, detail, transcript=F.col("transcript_id"), data=none) -> DataFrame:
        return rows.select("item_id", F.lit(kind).alias("kind"), severity.alias("severity"), transcript.alias("transcript_id"), data.alias("data_id"), detail.alias("detail"))

    by_test = F.array(
        F.when(F.col("stability").isin("warn", "block"), F.struct(F.lit("stability").alias("kind"), F.col("stability").alias("severity"), F.lit("the result depends on single points").alias("detail"))),
        F.when(~F.col("verified"), F.struct(F.lit("verification_mismatch").alias("kind"), F.lit("block").alias("severity"), F.lit("a recomputation gave other numbers").alias("detail"))),
        F.when(F.col("test_no") >= MANY_TESTS, F.struct(F.lit("multiple_comparisons").alias("kind"), F.lit("warn").alias("severity"), F.concat(F.col("test_no").cast("string"), F.lit(" tests on these data by then")).alias("detail"))),
    )
    found = mine.select("item_id", "transcript_id", F.explode(F.array_compact(by_test)).alias("f")).select("item_id", "f.kind", "f.severity", "transcript_id", none.alias("data_id"), "f.detail")
    data = mine.where("data_id is not null").groupBy("item_id", "data_id").agg(F.count_if(F.col("prediction").isNull()).alias("unforeseen"))
    found = found.unionByName(told(data.where("unforeseen > 0"), "no_prediction", F.lit("warn"), F.concat(F.col("unforeseen").cast("string"), F.lit(" tests before any prediction was written")), none, F.col("data_id")))
    wrong = governance.exclusions(exclusions).where("not accepted and data_id is not null").select("data_id", "at", F.lit(1).alias("_one"))
    # exclusions need no history of the tests
    held = listed.join(tests.where("data_id is not null").select("transcript_id", "data_id"), "transcript_id").groupBy("item_id", "data_id").agg(F.max("submitted_at").alias("submitted_at"))
    dropped = as_of(held, wrong, ["data_id"], "submitted_at", "at", excluded=("sum", "_one")).where("excluded > 0")
    found = found.unionByName(told(dropped, "exclusion_justified_by_result", F.lit("block"), F.concat(F.col("excluded").cast("string"), F.lit(" exclusions for a reason about the result")), none, F.col("data_id")))
    known = listed.join(numbers.select("transcript_id", F.col("number").alias("value")), "transcript_id").select("item_id", "value").distinct()
    off = guards.scan_numbers(submissions.select("item_id", "claim"), "item_id", "claim", known).groupBy("item_id").agg(F.count("*").alias("off"))
    return found.unionByName(told(off, "unverified_number_in_claim", F.lit("block"), F.concat(F.col("off").cast("string"), F.lit(" numbers come from none of the transcripts")), none))


def queue(items: DataFrame, flagged: DataFrame) -> DataFrame:
    """``items`` with the number of their flags and the worst severity, null without any."""
    rank = F.create_map(*(F.lit(x) for kv in governance.SEVERITY.items() for x in kv))
    per = flagged.groupBy(F.col("item_id").alias("_item")).agg(F.count("*").alias("flags"), F.max_by("severity", F.element_at(rank, F.col("severity"))).alias("worst"))
    return items.join(per, F.col("item_id").eqNullSafe(F.col("_item")), "left").drop("_item").withColumn("flags", F.coalesce("flags", F.lit(0)))


def children(parents: DataFrame, rows: DataFrame, parent: str, key: str, at: str, page: int = 50) -> DataFrame:
    """The latest ``page`` rows of each parent, numbered from 1; a parent without rows has none.

    For listings by workspace, data set or item; the number of rows of a parent is ``n``.
    """
    order = Window.partitionBy(parent).orderBy(F.desc(at), F.desc(key))
    counted = rows.join(parents.select(parent).distinct(), parent, "left_semi").withColumn("place", F.row_number().over(order)).where(F.col("place") <= page)
    total = rows.groupBy(F.col(parent).alias("_parent")).agg(F.count("*").alias("n"))
    return counted.join(total, F.col(parent) == F.col("_parent")).drop("_parent")
