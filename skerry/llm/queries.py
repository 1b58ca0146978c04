"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.llm import bpe, langid, merkle, mixing, mtree, near_dup, oracles, privacy, quality, token_counts, token_files, toxicity, warc, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _held_out(modulus: int, remainder: int) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == remainder, F.lit(False))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", _held_out(5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(_table(spark, sf_dir, "documents"), outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(_table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"), carry=False)
    return mixed.select("row.doc_id", "source", "tokens", "epoch", "block", "place")


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.top_k(_table(spark, sf_dir, "embeddings"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = warc.derivatives(warc.responses(_table(spark, sf_dir, "pages")), "page_id")
    return made.select("page_id", "record_type", "record_id", "refers_to", "target_uri", "source_digest", "block_digest", "content_length")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.fit(docs)).select("doc_id", _held_out(4, 2).alias("held_out"), "lang_pred", "score")


def op11_privacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = privacy.sanitise(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = F.col("found")
    return docs.select(
        "doc_id", *(F.size(found[k]).cast("long").alias(f"n_{k}") for k in privacy.KINDS), F.sha2(privacy.listed(found, privacy.KINDS), 256).alias("base_sha256"),
        privacy.listed(found, (*privacy.KINDS, "term")).alias("spans"), F.size(found["term"]).cast("long").alias("n_term"), F.sha2(F.col("sanitised"), 256).alias("sanitised_sha256"),
    )


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = merkle.lower_ascii(F.col("text"))
    touched = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return merkle.manifest(_table(spark, sf_dir, "documents"), tampered={"text": text}, where=touched)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_near_dup, op3_bpe, op4_quality, op5_token_counts, op6_token_files, op7_mixing, op8_top_k, op9_warc, op10_language, op11_privacy, op12_merkle, op13_whitening)}


def oracle_sql() -> dict[str, str]:
    return {"op7_mixing": oracles.OP7_MIXING, "op9_warc": oracles.op9_warc(), "op12_merkle": oracles.op12_merkle()}
