"""The record of what was run: transcripts, the ledger of tests, predictions, reviews, quotas.

Records are append-only tables; the present state of anything is the latest of its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skerry.operators.groups import holm

TRANSCRIPT = T.StructType([
    T.StructField("transcript_id", T.StringType()), T.StructField("seq", T.LongType()), T.StructField("tool", T.StringType()), T.StructField("data_id", T.StringType()),
    T.StructField("params", T.StringType()), T.StructField("result", T.StringType()), T.StructField("p_value", T.DoubleType()), T.StructField("effect_size", T.DoubleType()),
    T.StructField("n", T.LongType()), T.StructField("error", T.StringType()), T.StructField("started_at", T.TimestampType()), T.StructField("duration_ms", T.DoubleType()),
])
# Words that talk about results, which a reason for an exclusion must not.
RESULT_TALK = r"(?i)\b(?:significan\w*|p[- ]?value|result\w*|hypothes[ie]s|outlier|doesn'?t fit|does not fit|too (?:high|low)|spoil\w*|better|improve\w*)\b"
SEVERITY = {"info": 0, "warn": 1, "block": 2}


def fingerprint(df: DataFrame, *columns: str, by: tuple[str, ...] = ()) -> DataFrame:
    """One identity of each data set, whatever the order of its rows.

    Row digests are summed in two halves instead of being collected, so the size of a data set doesn't matter;
    counts and sums are digested once more to 32 hex digits.
    """
    row = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    half = lambda a: F.sum(F.conv(F.substring(row, a, 12), 16, 10).cast("decimal(38,0)"))
    s = df.groupBy(*by).agg(F.count("*").alias("n"), half(1).alias("x"), half(13).alias("y"))
    return s.select(*by, F.substring(F.sha2(F.concat_ws("|", "n", "x", "y"), 256), 1, 32).alias("data_id"))


def append_new(store: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows whose transcript_id the store doesn't hold yet; repeated ones count once."""
    return rows.dropDuplicates(["transcript_id"]).join(store.select("transcript_id"), "transcript_id", "left_anti")


def since(store: DataFrame, marker: int) -> DataFrame:
    return store.where(F.col("seq") > marker)


def ledger(store: DataFrame, alpha: float = 0.05, threshold: int = 3) -> DataFrame:
    """All successful tests of each data set; Holm's correction counts from the ``threshold``-th on.

    ``lost`` marks tests that are below alpha alone but not when corrected; false alarms are those expected by chance.
    """
    tests = store.where("error is null and p_value is not null and data_id is not null").select("data_id", "transcript_id", "seq", "tool", "p_value")
    rows = holm(tests, "p_value", ["data_id"], ["seq"])
    m = F.count("*").over(Window.partitionBy("data_id"))
    rows = rows.withColumn("tests", m).withColumn("corrected", F.when(F.col("tests") >= threshold, F.col("p_holm")).otherwise(F.col("p_value")))
    return rows.withColumn("lost", (F.col("p_value") < alpha) & (F.col("corrected") >= alpha)).withColumn("expected_false_alarms", F.col("tests") * F.lit(alpha)).drop("p_holm")


def behaviour(store: DataFrame, threshold: int = 3) -> DataFrame:
    """Per data set: tests, best p, whether the sample shrank, and the verdict: block from 6 tests, or from threshold + 1 with shrinking."""
    tests = store.where("error is null and p_value is not null and data_id is not null")
    s = tests.groupBy("data_id").agg(F.count("*").alias("tests"), F.min("p_value").alias("best_p"), F.min_by("p_value", "seq").alias("first_p"), F.min_by("n", F.when(F.col("n").isNotNull(), F.col("seq"))).alias("first_n"), F.max_by("n", F.when(F.col("n").isNotNull(), F.col("seq"))).alias("last_n"))
    s = s.withColumn("shrinking", F.coalesce(F.col("last_n") < F.col("first_n"), F.lit(False)))
    verdict = F.when((F.col("tests") >= 6) | (F.col("shrinking") & (F.col("tests") >= threshold + 1)), "block").when(F.col("tests") >= threshold, "warn").otherwise("none")
    return s.withColumn("severity", verdict)


def exclusions(log: DataFrame, reason: str = "justification") -> DataFrame:
    """Exclusions with ``accepted``: the reason is given and doesn't talk about results."""
    return log.withColumn("accepted", (F.length(F.trim(F.coalesce(reason, F.lit("")))) > 0) & ~F.coalesce(F.col(reason), F.lit("")).rlike(RESULT_TALK))


def predictions(log: DataFrame) -> DataFrame:
    """The first version of each data set's prediction holds; later ones are counted as amendments."""
    return log.groupBy("data_id").agg(F.min_by("prediction", "version").alias("prediction"), (F.count("*") - 1).alias("amendments"))


def judged(predicted: Column, effect: Column, p: Column, alpha: float = 0.05) -> Column:
    """supported, reversed or not supported, from the predicted direction (+1 or -1)."""
    return F.when((p < alpha) & (F.signum(effect) == predicted), "supported").when(p < alpha, "reversed").otherwise("not supported")


def next_version(log: DataFrame, key: str) -> DataFrame:
    return log.withColumn("version", F.row_number().over(Window.partitionBy(key).orderBy("created_at")))


def latest(log: DataFrame, key: str, at: str = "created_at") -> DataFrame:
    """The last row of each key: the present state of an append-only table."""
    return log.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(at)))).where("_rn = 1").drop("_rn")


def verify(claimed: DataFrame, computed: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Claimed records whose p, effect or statistic is off the recomputed one by more than absolute and relative tolerance; a missing one counts as off."""
    names = ["p_value", "effect_size", "statistic"]
    c = computed.select("transcript_id", *(F.col(n).alias(f"own_{n}") for n in names))
    off = F.array_compact(F.array(*(F.when(F.coalesce(F.abs(F.col(n) - F.col(f"own_{n}")) > tolerance * (1 + F.abs(F.col(f"own_{n}"))), F.col(n).isNull() != F.col(f"own_{n}").isNull()), F.lit(n)) for n in names)))
    return claimed.join(c, "transcript_id", "left").withColumn("mismatches", off)


def visible(workspaces: DataFrame, user: str, role: str) -> DataFrame:
    """Workspaces that a user may see: teachers and reviewers all, others their own and those that they are a member of."""
    if role in ("teacher", "reviewer", "admin"):
        return workspaces
    return workspaces.where((F.col("owner") == user) | F.array_contains("members", user))


def review_queue(items: DataFrame, workspaces: DataFrame) -> DataFrame:
    """Open items with their workspace's name and worst flag, latest first."""
    rank = F.create_map(*(F.lit(x) for kv in SEVERITY.items() for x in kv))
    worst = F.array_max(F.transform("flags", lambda f: F.struct(F.coalesce(F.element_at(rank, f["severity"]), F.lit(-1)).alias("rank"), f["severity"].alias("severity"))))
    open_items = latest(items, "item_id").where("status = 'open'")
    return open_items.join(workspaces.select("workspace_id", "name"), "workspace_id").withColumn("worst", worst["severity"]).orderBy(F.desc("created_at"))


def quota(jobs: DataFrame, limit: float = 600.0, days: int = 30) -> DataFrame:
    """Each job's used minutes in the days before it, per school, and whether it fits."""
    w = Window.partitionBy("school").orderBy(F.col("requested_at").cast("long")).rangeBetween(-days * 86_400, -1)
    used = F.coalesce(F.sum("minutes").over(w), F.lit(0.0))
    return jobs.withColumn("used", used).withColumn("accepted", used + F.col("minutes") <= limit)


def rounded_coordinates(df: DataFrame, *columns: str) -> DataFrame:
    """Coordinates to 3 decimals, halves to even."""
    for c in columns:
        df = df.withColumn(c, F.bround(F.col(c), 3))
    return df


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TRANSCRIPT).parquet(path)
