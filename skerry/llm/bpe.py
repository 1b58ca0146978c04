"""BPE encoding and decoding of whole texts (see ``byte_bpe`` for the method).

Defined cases: a null or empty text has no ids and decodes to the empty text; repeated rows give
repeated results; a null id is carried; other columns are ignored.
"""

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.llm import byte_bpe, words

#: What ``encode`` can return for each text, with its Spark type.
OUTPUTS = {"ids": "array<int>", "decoded": "string", "n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}


def encode(docs: DataFrame, path: str | None = None, outputs: Sequence[str] = ("ids", "decoded"), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The id column and the chosen ``outputs``: ids, the text decoded from them, their number and digests.

    ``ids_sha256`` is of the decimal ids joined by commas, ``decoded_sha256`` of the decoded text in UTF-8.
    """
    wanted = list(outputs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe.load(byte_bpe.resolve(path))
        for batch in words.slices(batches):
            columns: dict[str, list] = {k: [] for k in wanted}
            for text in batch.column(1).to_pylist():
                ids = np.frombuffer(bpe.encode(text), "<u4").tolist()
                for k in wanted:
                    if k == "ids":
                        value = ids
                    elif k == "n_tokens":
                        value = len(ids)
                    elif k == "ids_sha256":
                        value = hashlib.sha256(bpe.joined(ids).encode()).hexdigest()
                    elif k == "decoded":
                        value = bpe.decode(ids)
                    else:
                        value = hashlib.sha256(bpe.decode(ids).encode("utf-8", "surrogatepass")).hexdigest()
                    columns[k].append(value)
            kinds = {"ids": pa.list_(pa.int32()), "n_tokens": pa.int64()}
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(columns[k], kinds.get(k, pa.string())) for k in wanted)], names=["id", *wanted])

    got = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    got = got.mapInArrow(run, ", ".join(["id long", *(f"{k} {OUTPUTS[k]}" for k in wanted)]))
    return got.withColumnRenamed("id", id_column)


def decode(rows: DataFrame, path: str | None = None, ids_column: str = "ids", to: str = "decoded") -> DataFrame:
    """``rows`` with the text that its ids stand for in column ``to``; null ids give null."""

    @F.pandas_udf("string")
    def run(ids: pd.Series) -> pd.Series:
        bpe = byte_bpe.load(byte_bpe.resolve(path))
        return pd.Series([None if x is None else bpe.decode(list(x)) for x in ids], dtype=object)

    return rows.withColumn(to, run(ids_column))
