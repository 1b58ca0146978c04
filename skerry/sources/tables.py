"""Sources and sinks: FASTA, delimited text with an unknown separator, cached responses, the Parquet store."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skerry.operators.sequences import clean


def parse_fasta(texts: DataFrame, key: str, text: str, max_records: int | None = None) -> DataFrame:
    """Records of FASTA texts: seq_id (first word of the header, or record_N), description, sequence, length, dropped characters.

    Text before the first header and blank lines are ignored.  A cap keeps the first records of each text.
    """
    lines = texts.select(key, F.posexplode(F.split(text, "\r?\n")).alias("at", "line")).withColumn("line", F.trim("line")).where("line <> ''")
    number = F.sum(F.col("line").startswith(">").cast("int")).over(Window.partitionBy(key).orderBy("at"))
    lines = lines.withColumn("record", number).where("record > 0" if max_records is None else f"record between 1 and {max_records}")
    header = F.max(F.when(F.col("line").startswith(">"), F.trim(F.substring("line", 2, 1_000_000))))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("line").startswith(">"), F.struct("at", "line")))), lambda x: x["line"]), "")
    return _record(lines.groupBy(key, "record").agg(header.alias("description"), body.alias("raw")), key)


def _record(rows: DataFrame, *carried: str) -> DataFrame:
    raw = F.regexp_replace("raw", r"\s", "")
    name = F.when(F.coalesce(F.col("description"), F.lit("")) == "", F.concat(F.lit("record_"), F.col("record").cast("string"))).otherwise(F.substring_index("description", " ", 1))
    return rows.select(*carried, "record", name.alias("seq_id"), "description", clean(raw).alias("sequence")).withColumn("length", F.length("sequence")).join(
        rows.select(*carried, "record", F.length(raw).alias("_n")), [*carried, "record"]
    ).withColumn("non_standard", F.col("_n") - F.col("length")).drop("_n")


def _records_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces (value, file, start of the block) in a file's order, without what stands before the file's first header."""
    last = None
    for batch in batches:
        value, file, start = (c.to_pylist() for c in batch.columns)
        keep = []
        for v, block in zip(value, zip(file, start)):
            keep.append(block == last or block[1] > 0 or v.startswith(">"))
            last = block
        yield batch.filter(pa.array(keep, pa.bool_())).select(["value"])


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """FASTA files of any size: each record is one line of the reader, cut at '>' at a line's start.

    Text before a file's first header is ignored; a blank header is named record_ and a hash of its sequence; a record
    without header and sequence is none.
    """
    pieces = spark.read.option("lineSep", "\n>").text(path).select("value", F.input_file_name().alias("file"), F.input_file_block_start().alias("start"))
    rows = pieces.mapInArrow(_records_only, "value string").withColumn("value", F.regexp_replace("value", "^>", ""))
    head = F.trim(F.substring_index(F.regexp_replace("value", "\r", ""), "\n", 1))
    made = rows.select(head.alias("description"), clean(F.expr("substring(value, length(substring_index(value, '\\n', 1)) + 1)")).alias("sequence"))
    name = F.when(F.col("description") == "", F.concat(F.lit("record_"), F.substring(F.sha2("sequence", 256), 1, 12))).otherwise(F.substring_index("description", " ", 1))
    return made.where("description <> '' or sequence <> ''").select(name.alias("seq_id"), "description", "sequence").withColumn("length", F.length("sequence"))


def write_fasta(sequences: DataFrame, path: str) -> None:
    sequences.select(F.concat(F.lit(">"), F.coalesce("description", "seq_id"), F.lit("\n"), "sequence").alias("value")).write.text(path)


def separator(first_line: str) -> str:
    """Tab if the first line has one, else semicolon, else comma."""
    return next((s for s in ("\t", ";") if s in first_line), ",")


def read_delimited(spark: SparkSession, path: str) -> DataFrame:
    """A delimited file with a header, all columns as text; the separator is found in the first line."""
    first = spark.read.text(path).first()
    return spark.read.option("header", True).option("sep", separator(first["value"] if first else "")).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)


def cache_key(source: Column, path: Column, params: Column) -> Column:
    """48 hex digits of the request; ``params`` is a map, whose api_key is left out."""
    kept = F.map_filter(params, lambda k, _: k != "api_key")
    entries = F.array_sort(F.map_entries(kept))
    return F.substring(F.sha2(F.to_json(F.struct(source.alias("source"), path.alias("path"), entries.alias("params"))), 256), 1, 48)


def fresh(cache: DataFrame, now: Column) -> DataFrame:
    """The latest row of each key, with ``stale`` set if it has expired; a stale one serves when the source fails."""
    latest = cache.withColumn("_rn", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("fetched_at")))).where("_rn = 1").drop("_rn")
    return latest.withColumn("stale", F.coalesce(F.col("expires_at") <= now, F.lit(False)))


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)
