"""Tables as they are sent in: kept with their report, once, whether they are valid or not.

A data set is a folder of rows and one of issues under its id; both are replaced as a whole, so sending one again, or a
batch of a stream that is repeated after a failure, changes nothing.  What is listed has both: the register's row is
written last.

Defined cases: an invalid table is kept with its report and ``valid`` false; a table without rows is kept too; equal rows
are kept, and reported; an id that is sent with other rows replaces the old ones, and the register has its latest state.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.functions.columns import running
from skerry.functions.shared import written
from skerry.operators import governance, validate
from skerry.operators.validate import Rule

REGISTER = "dataset_id string, data_id string, rows long, issues long, blocks long, valid boolean, uploaded_at timestamp"


class Uploads:
    """Data sets with their reports in a folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        spark.createDataFrame([], REGISTER).write.mode("ignore").parquet(f"{self.folder}/register")

    def put(self, dataset_id: str, table: DataFrame, rules: list[Rule] | None = None, order: list[str] | None = None) -> None:
        """Keep a table, numbered from 0 in the order of ``order`` (all columns), with its issues."""
        if not re.fullmatch(r"[A-Za-z0-9_.-]+", dataset_id):
            raise ValueError("an id has letters, digits, dots, dashes and underscores")
        self._write(table, order or table.columns, f"{self.folder}/rows/{dataset_id}")
        rows = self.rows(dataset_id)
        validate.validate(rows, "row_index", rules).write.mode("overwrite").parquet(f"{self.folder}/issues/{dataset_id}")
        counts = self.issues(dataset_id).agg(F.count("*").alias("n"), F.count_if(F.col("severity") == "block").alias("b")).first()
        identity = governance.fingerprint(rows, *table.columns).first()["data_id"]
        row = (dataset_id, identity, rows.count(), counts["n"], counts["b"], counts["b"] == 0, datetime.now(timezone.utc))
        latest = self.register().where(F.col("dataset_id") == dataset_id).first()
        if latest is None or tuple(latest)[:6] != row[:6]:
            self.spark.createDataFrame([row], REGISTER).write.mode("append").parquet(f"{self.folder}/register")

    def _write(self, table: DataFrame, order: list[str], path: str) -> None:
        once = written(table.withColumn("_u_tie", F.monotonically_increasing_id()), "upload")
        numbered = running(once, [], [*order, "_u_tie"], row_index=("sum", F.lit(1))).withColumn("row_index", (F.col("row_index") - 1).cast("long"))
        numbered.drop("_u_tie").write.mode("overwrite").parquet(path)

    def rows(self, dataset_id: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/rows/{dataset_id}")

    def issues(self, dataset_id: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/issues/{dataset_id}")

    def register(self) -> DataFrame:
        """The latest row of each data set."""
        return governance.latest(self.spark.read.schema(REGISTER).parquet(f"{self.folder}/register"), "dataset_id", "uploaded_at")

    def each_batch(self, name: str, rules: list[Rule] | None = None) -> Callable[[DataFrame, int], None]:
        """For ``foreachBatch`` of a stream: every batch is a data set called by its number."""
        return lambda batch, number: self.put(f"{name}-{number}", batch, rules)
