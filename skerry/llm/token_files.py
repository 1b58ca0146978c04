"""Token-ID output as Arrow files of equal-length sequences.

``write`` encodes texts (``tokenizers`` library), appends an end id to each document and lays all
ids one after the other, in ascending document order.  Each range of documents is one file in
Arrow's random-access file format: record batches of fixed-size lists, ``input_ids`` (unsigned 16
bits if the vocabulary fits, else 32) and ``mask`` (whether a place is filled; only a file's last
sequence has empty places).  A sequence's place in the file follows from its number, so a memory
map reads it without copying.  Beside each file lies an index of its documents.

Files appear under their final name by a rename, and only those that a successful task reports
are in the manifest, so lost executors and repeated tasks leave no double rows.

Defined cases: a null or empty text is the end id alone; a null id sorts first; repeated rows follow
each other; an empty table writes no file; other columns are ignored.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.llm import byte_bpe
from skerry.llm.shared import new_path

LENGTH = 2048
SEQUENCES = 256
_INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def _store(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pyarrow.fs.LocalFileSystem(), path)


class SequenceWriter:
    """Packs ids into fixed-length sequences and writes them batch by batch."""

    def __init__(self, sink, length: int, width: int):
        kind = pa.uint16() if width == 2 else pa.uint32()
        self.length, self.dtype = length, np.dtype(f"<u{width}")
        self.schema = pa.schema([("input_ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.kind, self.out = kind, pa.ipc.new_file(sink, self.schema)
        self.held: list[np.ndarray] = []
        self.size = self.total = 0

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids.astype(self.dtype))
        self.size += len(ids)
        self.total += len(ids)
        if self.size >= self.length * SEQUENCES:
            self._flush(self.size - self.size % (self.length * SEQUENCES))

    def _flush(self, n: int) -> None:
        ids = np.concatenate(self.held)
        self.held, self.size = [ids[n:]], len(ids) - n
        for at in range(0, n, self.length * SEQUENCES):
            part = ids[at : min(at + self.length * SEQUENCES, n)]
            room = -len(part) % self.length
            full = np.concatenate([part, np.zeros(room, self.dtype)]) if room else part
            mask = np.arange(len(full)) < len(part)
            self.out.write_batch(pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(full, self.kind), self.length), pa.FixedSizeListArray.from_arrays(pa.array(mask), self.length)], schema=self.schema))

    def close(self) -> None:
        if self.size:
            self._flush(self.size)
        self.out.close()


class SequenceFile:
    """Random access to one file: sequence by number, or any run of ids; no copy within a batch."""

    def __init__(self, path: str):
        store, at = _store(path)
        source = pa.memory_map(at) if isinstance(store, pyarrow.fs.LocalFileSystem) else store.open_input_file(at)
        self.file = pa.ipc.open_file(source)
        self.length = self.file.schema.field("input_ids").type.list_size

    def _batch(self, k: int) -> pa.RecordBatch:
        return self.file.get_batch(k)

    def sequence(self, number: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of one sequence."""
        batch, row = self._batch(number // SEQUENCES), number % SEQUENCES
        cut = slice(row * self.length, (row + 1) * self.length)
        return batch.column(0).values.to_numpy()[cut], batch.column(1).values[cut].to_numpy(zero_copy_only=False)

    def run(self, start: int, n: int) -> np.ndarray:
        """``n`` ids from place ``start`` of the file."""
        per, parts = self.length * SEQUENCES, []
        while n > 0:
            ids = self._batch(start // per).column(0).values.to_numpy()[start % per : start % per + n]
            parts.append(ids)
            start, n = start + len(ids), n - len(ids)
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.empty(0, np.uint32)


def write(docs: DataFrame, folder: str, path: str | None = None, end_id: int = 0, length: int = LENGTH, width: int = 2) -> DataFrame:
    """Write ``doc_id``, ``text`` rows as files in ``folder``; returns the manifest: file, its first place, its ids.

    ``width`` is the bytes of an id (2 for vocabularies up to 65 536, else 4).
    """
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, store, base = byte_bpe.load_library(byte_bpe.resolve(path)), None, None
        end = np.array([end_id], np.uint32)
        for batch in batches:
            if not batch.num_rows:
                continue
            if store is None:
                store, base = _store(folder)
                store.create_dir(base, recursive=True)
                name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
                held = os.path.join(base, f"_{name}")
                out, index = store.open_output_stream(f"{held}.arrow"), store.open_output_stream(f"{held}.index")
                sequences, documents = SequenceWriter(out, length, width), pa.ipc.new_file(index, _INDEX)
            starts, sizes = [], []
            for text in batch.column(1).to_pylist():
                ids = np.frombuffer(encoder.encode(text), "<u4")
                if width == 2 and len(ids) and ids.max() > 0xFFFF:
                    raise ValueError("an id needs more than 2 bytes: write with width=4")
                starts.append(sequences.total)
                sequences.add(np.concatenate([ids, end]))
                sizes.append(len(ids) + 1)
            documents.write_batch(pa.record_batch([batch.column(0), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())], schema=_INDEX))
        if store is not None:
            sequences.close()
            documents.close()
            out.close()
            index.close()
            for kind in ("arrow", "index"):
                store.move(f"{held}.{kind}", os.path.join(base, f"{name}.{kind}"))
            yield pa.record_batch([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([f"{folder}/{name}"]), pa.array([sequences.total], pa.int64())], names=["part", "file", "n_ids"])

    files = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
        .mapInArrow(run, "part int, file string, n_ids long")
        .collect()  # one row per file
    )
    start, rows = 0, []
    for f in sorted(files, key=lambda f: f["part"]):
        rows.append((f["file"], start, f["n_ids"]))
        start += f["n_ids"]
    return spark.createDataFrame(rows, "file string, first long, n_ids long")


def read(manifest: DataFrame) -> DataFrame:
    """Per document, from the files: ``doc_id``, ``start`` (ids before it), ``n_tokens``, ``ids_crc32``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                sequences = SequenceFile(f"{row['file']}.arrow")
                store, at = _store(f"{row['file']}.index")
                with store.open_input_file(at) as f:
                    reader = pa.ipc.open_file(f)
                    for k in range(reader.num_record_batches):
                        index = reader.get_batch(k)
                        starts, sizes = index.column(1).to_numpy(), index.column(2).to_numpy()
                        sums = [zlib.crc32(sequences.run(int(s), int(n)).astype("<u4").tobytes()) for s, n in zip(starts, sizes)]
                        yield pa.record_batch([index.column(0), pa.array(starts + row["first"], pa.int64()), index.column(2), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    n = max(1, manifest.count())
    return manifest.repartition(n).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, path: str | None = None, end_id: int = 0) -> DataFrame:
    """Write to the shared folder and read back."""
    return read(write(docs, new_path(docs.sparkSession, "tokens"), path, end_id))
