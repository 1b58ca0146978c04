"""A cache of answers from upstream sources, in a folder: what is fresh is read, the rest is asked for by tasks.

Rows are only added; the latest row of a key is its state.  An answer that has expired is served all the same if the
source fails, marked as stale.  Answers are written before they are handed on, so a lost executor repeats no request that
was answered, and a request that a retried task repeats adds a row with the same key.

Defined cases: equal requests are asked once and answered each; a null parameter map counts as an empty one; a failed
request without an earlier answer has its error and no body; an empty table of requests asks nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.functions.shared import written
from skerry.sources.tables import cache_key, fresh

ENTRY = "key string, source string, path string, body string, fetched_at timestamp, expires_at timestamp"


class Cache:
    """Answers in a folder; ``lifetimes`` are in days by source."""

    def __init__(self, spark: SparkSession, folder: str, lifetimes: dict[str, float], default_days: float = 7.0) -> None:
        self.spark, self.folder, self.lifetimes, self.default_days = spark, folder.rstrip("/"), lifetimes, default_days
        spark.createDataFrame([], ENTRY).write.mode("ignore").parquet(self.folder)

    def rows(self) -> DataFrame:
        return self.spark.read.schema(ENTRY).parquet(self.folder)

    def add(self, answers: DataFrame, now: datetime) -> None:
        """Keep (key, source, path, body) as fetched at ``now``."""
        days = F.coalesce(*(F.when(F.col("source") == s, F.lit(float(d))) for s, d in self.lifetimes.items()), F.lit(self.default_days))
        expires = F.timestamp_micros(F.unix_micros(F.lit(now)) + (days * F.lit(86_400_000_000)).cast("long"))
        answers.select("key", "source", "path", "body", F.lit(now).alias("fetched_at"), expires.alias("expires_at")).write.mode("append").parquet(self.folder)

    def fetch(self, requests: DataFrame, ask: Callable[[str, str, dict], str], now: datetime) -> DataFrame:
        """``requests`` (source, path, params) with key, body, state (hit, fetched, stale or failed) and error.

        ``ask`` runs in tasks, once for each different request that isn't fresh; what it raises is the error.
        """
        none = F.create_map().cast("map<string,string>")
        keyed = written(requests.select("source", "path", F.coalesce("params", none).alias("params")).withColumn("key", cache_key(F.col("source"), F.col("path"), F.col("params"))), "requests")
        known = fresh(self.rows(), F.lit(now)).select(F.col("key").alias("_key"), F.col("body").alias("_body"), "stale")
        asked = keyed.dropDuplicates(["key"]).join(known, F.col("key") == F.col("_key"), "left").drop("_key")
        state = F.when(F.col("stale").isNull(), "missing").when(F.col("stale"), "expired").otherwise("hit")
        asked = written(asked.withColumn("_state", state), "asked")

        def ask_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                out = []
                for r in pdf.itertuples(index=False):
                    try:
                        out.append((r.key, r.source, r.path, str(ask(r.source, r.path, dict(r.params))), None))
                    except Exception as e:  # the source's failure is the answer
                        out.append((r.key, r.source, r.path, None, f"{type(e).__name__}: {e}"))
                yield pd.DataFrame(out, columns=["key", "source", "path", "body", "error"])

        open_ = asked.where("_state <> 'hit'").select("key", "source", "path", "params")
        got = written(open_.mapInPandas(ask_all, "key string, source string, path string, body string, error string"), "answers")
        self.add(got.where("error is null"), now)
        new = got.select(F.col("key").alias("_key"), F.col("body").alias("_new"), "error")
        found = asked.select("key", "_body", "_state").join(new, F.col("key") == F.col("_key"), "left")
        answer = found.select(
            F.col("key").alias("_k"), F.coalesce("_new", "_body").alias("body"),
            F.when(F.col("_state") == "hit", "hit").when(F.col("_new").isNotNull(), "fetched").when(F.col("_state") == "expired", "stale").otherwise("failed").alias("state"), "error",
        )
        return keyed.join(answer, F.col("key") == F.col("_k")).drop("_k")

    def status(self, now: datetime) -> DataFrame:
        return status(self.rows(), F.lit(now))


def status(cache: DataFrame, now) -> DataFrame:
    """Per source: keys, those that are fresh and expired, rows with the replaced ones, and the latest answer's time."""
    latest = fresh(cache, now)
    rows = cache.groupBy(F.col("source").alias("_s")).agg(F.count("*").alias("rows"))
    s = latest.groupBy("source").agg(F.count("*").alias("keys"), F.count_if(~F.col("stale")).alias("fresh"), F.count_if(F.col("stale")).alias("expired"), F.max("fetched_at").alias("latest"))
    return s.join(rows, F.col("source").eqNullSafe(F.col("_s"))).select("source", "keys", "fresh", "expired", "rows", "latest")
