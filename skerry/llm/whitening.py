"""Whitening of embeddings by their leading principal components, by matrix-free block Lanczos.

Vectors become whole numbers, floor(256 x).  The fit list holds each distinct vector once; the covariance V is taken
over it, with its size as divisor.  V is never made: one pass over the fit list multiplies it with a block of ``BLOCK``
columns, each task sums Z'(Z Q) of its rows z = x - mean, and the tasks' sums are added by rows of the product.  The
driver holds the Krylov basis, at most ``MAX_BASIS`` columns of the vectors' dimension:

- a product is made orthogonal to the whole basis, twice, and its orthonormal columns are the next block;
- columns that vanish (a breakdown: the space so far is invariant) are started anew at random, outside the basis;
- a full basis is restarted from its best Ritz vectors;
- the work ends when the residuals |V y - e y| of the wanted pairs are at most ``TOLERANCE`` of the greatest
  eigenvalue and a further pass no longer halves them, or when the basis spans the whole space.

The trace comes from the exact deviations of the fit list, so that shares need no other eigenvalue.

Defined cases: rows whose vector is null or holds a null or non-finite entry take no part; shorter vectors count as if
filled up with zeros; equal vectors have equal results, a null id is carried; components without variance (at most
``RANK`` of the trace) are left out, so a table with fewer than two distinct vectors, or none, gives no rows;
a number beyond 62 bits or a deviation beyond 64 bits is an error; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.llm.shared import stage

BLOCK, MAX_BASIS = 16, 384
TOLERANCE, RANK = 1e-13, 1e-13
MAX_PASSES = 1000
SUM_ROWS = 4096
LOW = (1 << 32) - 1


def whole_numbers(vectors: DataFrame, id_column: str, vector_column: str, scale: int) -> DataFrame:
    """(vec_id, x) of the rows that take part."""
    entry = F.col(vector_column).cast("array<double>")
    rows = vectors.select(F.col(id_column).alias("vec_id"), entry.alias("v"))
    rows = rows.where(F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
    checked = lambda x: F.when(F.abs(x * scale) >= F.lit(2.0**62), F.raise_error(F.lit("a component needs more than 62 bits")).cast("long")).otherwise(F.floor(x * scale))
    return rows.select("vec_id", F.transform("v", checked).alias("x"))


def filled(x: DataFrame, dim: int) -> DataFrame:
    missing = F.array_repeat(F.lit(0).cast("long"), F.lit(dim) - F.size("x"))
    return x.withColumn("x", F.when(F.size("x") < dim, F.concat("x", missing)).otherwise(F.col("x")))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.int64, copy=False)


def _slices(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for a in range(0, batch.num_rows, SUM_ROWS):
            part = batch.slice(a, SUM_ROWS)
            yield part, _matrix(part.column("x"), dim)


class Fit:
    """The fit list with its size, sums and centre; products of its covariance with blocks."""

    def __init__(self, rows: DataFrame, dim: int) -> None:
        self.rows, self.dim = rows, dim
        self.n, sums = self._sums()
        #: x - base - rest / n is the deviation from the mean; base is whole, 0 <= rest < n.
        self.base = np.array([s // self.n for s in sums], np.int64) if self.n else np.zeros(dim, np.int64)
        self.rest = np.array([s - int(b) * self.n for s, b in zip(sums, self.base, strict=True)], np.int64)

    def _sums(self) -> tuple[int, list[int]]:
        """Size, and exact sums: high and low halves of the numbers are added apart."""
        dim = self.dim

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, high, low = 0, np.zeros(dim, np.int64), np.zeros(dim, np.int64)
            for _, x in _slices(batches, dim):
                n += len(x)
                high += (x >> 32).sum(axis=0)
                low += (x & LOW).sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array([n] * dim, pa.int64()), pa.array(high), pa.array(low)], ["at", "n", "high", "low"])

        whole = lambda c: F.sum(F.col(c).cast("decimal(20,0)")).cast("string").alias(c)
        # one row a dimension
        found = sorted(self.rows.mapInArrow(partial, "at int, n long, high long, low long").groupBy("at").agg(F.sum("n").alias("n"), whole("high"), whole("low")).collect())
        return (found[0]["n"] if found else 0), [(int(r["high"]) << 32) + int(r["low"]) for r in found] or [0] * dim

    def product(self, q: np.ndarray) -> np.ndarray:
        """V q in one pass; each task sends a row of sums for each dimension."""
        dim, n, base, mean = self.dim, self.n, self.base, self.rest / max(self.n, 1)
        q = np.ascontiguousarray(q)

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, seen = np.zeros_like(q), False
            for _, x in _slices(batches, dim):
                z, seen = (x - base) - mean, True
                total += z.T @ (z @ q)
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["at", "sums"])

        sums = self.rows.mapInArrow(partial, "at int, sums array<double>")
        added = sums.groupBy("at").agg(*(F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(q.shape[1])))
        found = np.zeros_like(q)
        for r in added.collect():
            found[r["at"]] = tuple(r)[1:]
        return found / n

    def trace(self) -> float:
        """Trace of V: the sum of all deviations over n^3."""
        dim, n, base, rest = self.dim, self.n, self.base, self.rest

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = 0
            for _, x in _slices(batches, dim):
                total += sum(deviations(x, n, base, rest).tolist())
            yield pa.RecordBatch.from_arrays([pa.array([str(total)])], ["total"])

        total = self.rows.mapInArrow(partial, "total string").agg(F.sum(F.col("total").cast("decimal(38,0)")).cast("string")).first()[0]
        return int(total or 0) / self.n**3 if self.n else 0.0


def deviations(x: np.ndarray, n: int, base: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Sum over dimensions of (n x - S)^2, exact; in Python's integers where 64 bits could overflow."""
    low, high = x.min(axis=0).tolist() if len(x) else [], x.max(axis=0).tolist() if len(x) else []
    most = max((max(abs(n * (a - b)), abs(n * (c - b))) + n for a, c, b in zip(low, high, base.tolist(), strict=True)), default=0)
    if most**2 * max(x.shape[1], 1) < 2**63:
        d = n * (x - base) - rest
        return (d * d).sum(axis=1)
    d = n * (x.astype(object) - base.astype(object)) - rest.astype(object)
    found = (d * d).sum(axis=1)
    if any(v >= 2**63 for v in found):
        raise OverflowError("a deviation needs more than 64 bits")
    return found.astype(np.int64)


def orthonormal(w: np.ndarray, basis: np.ndarray, random: np.random.Generator, scale: float) -> np.ndarray:
    """Orthonormal columns for ``w`` outside the basis; vanished ones start anew, as far as the space has room."""
    dim, held = basis.shape
    began = np.linalg.norm(w, axis=0)
    for _ in range(2):
        w = w - basis @ (basis.T @ w)
    # the basis and the new columns side by side
    wide = np.empty((dim, min(held + w.shape[1], dim)), order="F")
    wide[:, :held] = basis
    for j in range(held, wide.shape[1]):
        v, least = w[:, j - held], max(1e-10 * began[j - held], 1e-14 * scale)
        while True:
            for _ in range(2):
                v = v - wide[:, :j] @ (wide[:, :j].T @ v)
            left = np.linalg.norm(v)
            if left > least:
                break
            v = random.standard_normal(dim)
            least = 1e-10 * np.linalg.norm(v)
        # once more at unit length, so that what rounding left of the basis goes too
        v = v / left
        v -= wide[:, :j] @ (wide[:, :j].T @ v)
        wide[:, j] = v / np.linalg.norm(v)
    return wide[:, held:].copy()


def lanczos(product, dim: int, wanted: int, block: int = BLOCK, max_basis: int = MAX_BASIS, tolerance: float = TOLERANCE, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` greatest eigenvalues, falling, and their unit eigenvectors as columns.

    ``product`` multiplies the matrix with a block of columns.
    """
    wanted, block = min(wanted, dim), min(max(block, wanted), dim)
    max_basis = min(max(max_basis, 3 * block + wanted), dim)
    random = np.random.default_rng(seed)
    basis, image = np.zeros((dim, 0)), np.zeros((dim, 0))
    new = orthonormal(random.standard_normal((dim, block)), basis, random, 1.0)
    before = np.inf
    for _ in range(MAX_PASSES):
        w = product(new)
        basis, image = np.column_stack([basis, new]), np.column_stack([image, w])
        projected = basis.T @ image
        values, turned = np.linalg.eigh((projected + projected.T) / 2)
        values, turned = values[::-1], turned[:, ::-1]
        residuals = np.linalg.norm(image @ turned[:, :wanted] - (basis @ turned[:, :wanted]) * values[:wanted], axis=0)
        scale = max(abs(values[0]), abs(values[-1]))
        settled = residuals.max() <= tolerance * scale and residuals.max() > before / 2
        before = residuals.max()
        if basis.shape[1] == dim or settled or before == 0:
            vectors = basis @ turned[:, :wanted]
            return values[:wanted], vectors / np.linalg.norm(vectors, axis=0)
        if basis.shape[1] + block > max_basis < dim:
            # the next block must come from the last product, outside the whole old basis
            further = orthonormal(w, basis, random, scale)
            kept = turned[:, : max(wanted, max_basis - 2 * block)]
            basis, image = basis @ kept, image @ kept
            new = orthonormal(further, basis, random, 1.0)
        else:
            new = orthonormal(w, basis, random, scale)
    raise ArithmeticError(f"no convergence within {MAX_PASSES} passes")


def whiten(vectors: DataFrame, components: int = 4, id_column: str = "vec_id", vector_column: str = "embedding", scale: int = 256) -> DataFrame:
    """A row for each remaining row and component: id, component, n, deviation, whitened, explained, identity_error."""
    kind = vectors.schema[id_column].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    x = stage(whole_numbers(vectors, id_column, vector_column, scale), "whole")
    dim = x.agg(F.max(F.size("x"))).first()[0] or 0
    none = vectors.sparkSession.createDataFrame([], schema).withColumnRenamed("vec_id", id_column)
    if not dim:
        return none
    x = filled(x, dim)
    fit = Fit(stage(x.select("x").distinct(), "fit"), dim)
    trace = fit.trace()
    if not trace > 0:
        return none
    values, axes = lanczos(fit.product, dim, components)
    held = values > RANK * trace
    values, axes = values[held], axes[:, held]
    n, base, rest = fit.n, fit.base, fit.rest
    mean, shares, to = rest / n, (values / trace).tolist(), axes / np.sqrt(values)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = to.shape[1]
        sums, squares = np.zeros(k), np.zeros((k, k))
        for _, part in _slices(batches, dim):
            w = ((part - base) - mean) @ to
            sums += w.sum(axis=0)
            squares += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(range(k + 1), pa.int32()), pa.array([*squares, sums], pa.list_(pa.float64()))], ["at", "sums"])

    k = len(values)
    found = fit.rows.mapInArrow(moments, "at int, sums array<double>").groupBy("at").agg(*(F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(k))).collect()
    at = {r["at"]: np.array(tuple(r)[1:]) / n for r in found}
    covariance = np.stack([at[i] for i in range(k)]) - np.outer(at[k], at[k])
    error = float(np.abs(covariance - np.eye(k)).max())

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, v in _slices(batches, dim):
            w = ((v - base) - mean) @ to
            rows = np.repeat(np.arange(len(v)), k)
            yield pa.RecordBatch.from_arrays(
                [part.column("vec_id").take(pa.array(rows)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(v))), pa.array(np.full(len(rows), n)), pa.array(np.repeat(deviations(v, n, base, rest), k)), pa.array(w.ravel()), pa.array(np.tile(shares, len(v))), pa.array(np.full(len(rows), error))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return x.mapInArrow(project, schema).withColumnRenamed("vec_id", id_column)
