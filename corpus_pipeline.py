"""A corpus from raw documents to token digests: five stages, each over all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as
Parquet in the shared folder and reads it again for the next one.  All stages but the last return
the columns of ``documents`` as they came, further ones included.

Decisions are a row's own: they are joined by doc_id and a hash of the text, null ids included.  Every stage of an
empty table is empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.llm import bpe, langid, mixing, near_dup, quality
from skerry.llm.shared import bounded, stage

#: A language is sure enough from this probability on.
LEAST_LANGUAGE_SCORE = 0.5
MAX_BROADCAST_IDS = 1_000_000
#: Rows of null or repeated ids are numbered from here on.
ODD_IDS = 1 << 62


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("_digest", F.xxhash64("text"))


def _keep(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id and digest are among ``decided``."""
    kept = stage(decided.select(F.col("doc_id").alias("_id"), F.col("_digest").alias("_of")).distinct(), "kept")
    return docs.join(bounded(kept, MAX_BROADCAST_IDS), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_of")), "left_semi").select(*docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie near a reference language.

    Texts that are null, empty or of under 50 words go; repeated rows are judged alike; a null or blank ``lang`` is judged by all references.
    """
    return _keep(docs, quality.judge(_keyed(docs), "doc_id", "_digest").where("kept"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found with enough probability.

    Texts without a letter go, and all do if no row has a language to learn from; repeated rows are judged alike.
    """
    found = langid.predict(_keyed(docs), langid.fit(docs), "_digest")
    return _keep(docs, found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE_SCORE)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the least doc_id.

    Rows of a null or repeated id are documents of their own with numbers beyond all ids, so an ordinary row of their
    group stays in their place; texts without words are linked with nothing and stay.
    """
    repeated = stage(docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").select("doc_id"), "odd-ids")
    if repeated.isEmpty():
        kept = stage(near_dup.near_duplicates(docs).where("kept").select("doc_id"), "first")
        return docs.join(bounded(kept, MAX_BROADCAST_IDS), "doc_id", "left_semi").select(*docs.columns)
    repeated = bounded(repeated.withColumnRenamed("doc_id", "_id"), MAX_BROADCAST_IDS)
    match = F.col("doc_id").eqNullSafe(F.col("_id"))
    odd = docs.join(repeated, match, "left_semi").withColumn("_row", F.lit(ODD_IDS) + F.monotonically_increasing_id())
    # written once, so that a row's number doesn't change
    rows = stage(docs.join(repeated, match, "left_anti").withColumn("_row", F.col("doc_id").cast("long")).unionByName(stage(odd, "odd")), "numbered")
    kept = stage(near_dup.near_duplicates(rows.select(F.col("_row").alias("doc_id"), "text")).where("kept").select(F.col("doc_id").alias("_row")), "first")
    return rows.join(bounded(kept, MAX_BROADCAST_IDS), "_row", "left_semi").select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at tempered weights: a row for each copy that the mixture takes, in as many tokens as there are.

    A null source is a source of its own; rows of a null id are drawn by a hash of the row; texts without bytes have no tokens.
    """
    return mixing.mix(docs).select("row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token digests of every row of the mixture; a null text has the digest of an empty one."""
    return bpe.encode(docs, outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


STAGES = [("quality_rules", quality_rules), ("language", language), ("near_duplicates", near_duplicates), ("mixture", mixture), ("tokens", tokens)]

#: No SQL: the language network and the forest have none; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs
