"""Language ID: a convolutional network over bytes, trained in numpy, run over whole texts.

Bytes (A-Z as a-z) are embedded; filters of widths 2, 3 and 4 slide over a fixed-length window, each
filter's greatest response counts (max pooling), and a softmax over the pooled responses gives the
languages.  A text is covered by consecutive windows that overlap by the widest filter less one
byte; its probabilities are the windows' means, weighted by their bytes.

Training takes windows of a bounded sample of labelled rows: about ``per_language`` documents a
language, chosen by a hash of the id, ``windows_each`` windows of each.  The model has a fixed size.

Defined cases: a null text or one without a letter (Unicode category L) is ``und`` with score 0.0; without labelled rows
every text is ``und``; rows with a null or empty language teach nothing; a null id is scored and
teaches nothing; ties go to the language first in order; repeated rows are scored alike; other
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skerry.llm import words
from skerry.llm.shared import bounded

WINDOW = 256
WIDTHS = (2, 3, 4)
EMBED, FILTERS = 8, 16
OVERLAP = max(WIDTHS) - 1
PAD = 32
_LETTER = regex.compile(r"\p{L}")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLOCK = 256


@dataclass
class ByteCNN:
    """Weights, and the tables that scoring looks up: the response of one or two adjacent bytes to a filter's taps."""

    labels: list[str]
    embed: np.ndarray
    taps: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray

    @classmethod
    def new(cls, labels: list[str], seed: int = 7) -> ByteCNN:
        r = np.random.default_rng(seed)
        n = len(WIDTHS) * FILTERS
        return cls(
            labels,
            r.normal(0, 0.5, (256, EMBED)).astype(np.float32),
            [r.normal(0, (w * EMBED) ** -0.5, (w, EMBED, FILTERS)).astype(np.float32) for w in WIDTHS],
            [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
            r.normal(0, n**-0.5, (n, len(labels))).astype(np.float32),
            np.zeros(len(labels), np.float32),
        )

    def _responses(self, x: np.ndarray, k: int) -> np.ndarray:
        """Responses (window, place, filter) of the filters of width ``WIDTHS[k]``."""
        n = x.shape[1] - WIDTHS[k] + 1
        single = [self.embed @ t for t in self.taps[k]]
        total = single[0][x[:, :n]]
        for j in range(1, WIDTHS[k]):
            total = total + single[j][x[:, j : j + n]]
        return total

    def pair_tables(self) -> list[list[tuple[int, np.ndarray]]]:
        """For each width: (first place, table) with one row per pair of bytes, or per byte for a last odd tap."""
        tables = []
        for k, w in enumerate(WIDTHS):
            single = [self.embed @ t for t in self.taps[k]]
            rows: list[tuple[int, np.ndarray]] = []
            for j in range(0, w - 1, 2):
                rows.append((j, (single[j][:, None] + single[j + 1][None]).reshape(65536, FILTERS)))
            if w % 2:
                rows.append((w - 1, single[w - 1]))
            tables.append(rows)
        return tables

    def probabilities(self, x: np.ndarray, tables: list | None = None) -> np.ndarray:
        """Softmax over languages of each window."""
        tables = tables or self.pair_tables()
        found = np.empty((len(x), len(self.labels)), np.float32)
        for a in range(0, len(x), _BLOCK):
            part = x[a : a + _BLOCK]
            pairs = part[:, :-1].astype(np.int32) << 8 | part[:, 1:]
            pooled = []
            for k, w in enumerate(WIDTHS):
                n = part.shape[1] - w + 1
                total = None
                for j, table in tables[k]:
                    got = np.take(table, (pairs if len(table) > 256 else part)[:, j : j + n], axis=0)
                    total = got if total is None else np.add(total, got, out=total)
                pooled.append(np.maximum(total.max(axis=1) + self.bias[k], 0))
            z = np.concatenate(pooled, axis=1) @ self.out + self.out_bias
            z = np.exp(z - z.max(axis=1, keepdims=True))
            found[a : a + _BLOCK] = z / z.sum(axis=1, keepdims=True)
        return found

    def train(self, x: np.ndarray, y: np.ndarray, steps: int = 400, batch: int = 128, rate: float = 0.01, seed: int = 11) -> None:
        """Adam on cross-entropy; max pooling sends each filter's gradient to its greatest response only."""
        r = np.random.default_rng(seed)
        params = [self.embed, *self.taps, *self.bias, self.out, self.out_bias]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        rows = np.arange(batch)[:, None]
        for step in range(1, steps + 1):
            pick = r.integers(0, len(x), batch)
            part, target = x[pick], y[pick]
            pooled, best = [], []
            for k in range(len(WIDTHS)):
                responses = self._responses(part, k)
                at = responses.argmax(axis=1)
                best.append(at)
                pooled.append(np.take_along_axis(responses, at[:, None, :], axis=1)[:, 0] + self.bias[k])
            hidden = np.concatenate(pooled, axis=1)
            z = np.maximum(hidden, 0) @ self.out + self.out_bias
            z = np.exp(z - z.max(axis=1, keepdims=True))
            d = z / z.sum(axis=1, keepdims=True)
            d[np.arange(batch), target] -= 1
            d /= batch
            grads = [np.zeros_like(p) for p in params]
            grads[-2], grads[-1] = np.maximum(hidden, 0).T @ d, d.sum(axis=0)
            back = (d @ self.out.T) * (hidden > 0)
            for k, w in enumerate(WIDTHS):
                g = back[:, k * FILTERS : (k + 1) * FILTERS]
                grads[1 + len(WIDTHS) + k] = g.sum(axis=0)
                for j in range(w):
                    seen = part[rows, best[k] + j]
                    grads[1 + k][j] = np.einsum("bfd,bf->df", self.embed[seen], g)
                    np.add.at(grads[0], seen.ravel(), (g[..., None] * self.taps[k][j].T[None]).reshape(-1, EMBED))
            for p, g, m, v in zip(params, grads, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)


def windows(raws: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of all texts, the text that each belongs to, and the bytes that it adds."""
    stride = WINDOW - OVERLAP
    counts = np.array([max(1, -(-(len(r) - OVERLAP) // stride)) for r in raws], np.int64)
    x = np.full((int(counts.sum()), WINDOW), PAD, np.uint8)
    weight = np.empty(len(x))
    at = 0
    for raw, n in zip(raws, counts):
        flat = np.full((n - 1) * stride + WINDOW, PAD, np.uint8)
        flat[: len(raw)] = np.frombuffer(raw, np.uint8)
        x[at : at + n] = np.lib.stride_tricks.sliding_window_view(flat, WINDOW)[::stride]
        weight[at : at + n] = np.clip(len(raw) - np.arange(n) * stride, 1, WINDOW)
        at += n
    return _LOWER[x], np.repeat(np.arange(len(raws)), counts), weight


def fit(docs: DataFrame, held_out_remainder: int = 2, modulus: int = 4, per_language: int = 400, windows_each: int = 4, steps: int = 250) -> ByteCNN | None:
    """Train on rows of non-null ``lang`` whose crc32(doc_id as text) leaves another remainder than the held-out one."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where(
        (F.crc32(F.col("doc_id").cast("string")) % modulus != held_out_remainder) & (F.col("lang") != "") & F.col("text").isNotNull()
    )
    shares = rows.groupBy("lang").agg((F.lit(per_language) / F.count("*")).alias("share"))
    chosen = rows.join(bounded(shares, 100_000), "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.col("share") * (1 << 20))

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, found = [], []
            for key, text, lang in zip(*(c.to_pylist() for c in batch.columns)):
                raw = text.encode("utf-8", "replace")
                if not _LETTER.search(text):
                    continue
                for k in range(windows_each):
                    room = max(0, len(raw) - WINDOW)
                    a = zlib.crc32(f"{key}/{k}".encode()) % (room + 1)
                    langs.append(lang)
                    found.append(raw[a : a + WINDOW].ljust(WINDOW, b" "))
                    if not room:
                        break
            yield pa.record_batch([pa.array(langs, pa.string()), pa.array(found, pa.binary())], names=["lang", "window"])

    sampled = chosen.select("doc_id", "text", "lang").mapInArrow(sample, "lang string, window binary")
    # the share bounds the rows of unique ids; the rank also bounds rows that share one id
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("window"), "window"))
    got = sampled.withColumn("place", place).where(F.col("place") <= 2 * per_language * windows_each).drop("place").toPandas().sort_values(["lang", "window"])
    if got.empty:
        return None
    labels = sorted(set(got["lang"]))
    x = _LOWER[np.frombuffer(b"".join(got["window"]), np.uint8).reshape(-1, WINDOW)]
    y = got["lang"].map({k: i for i, k in enumerate(labels)}).to_numpy()
    # every language weighs alike
    order = np.concatenate([np.resize(np.flatnonzero(y == k), np.bincount(y).max()) for k in range(len(labels))])
    model = ByteCNN.new(labels)
    if len(labels) > 1:
        model.train(x[order], y[order], steps)
    return model


def predict(docs: DataFrame, model: ByteCNN | None, *carried: str) -> DataFrame:
    """``doc_id``, the ``carried`` columns, ``lang_pred`` and ``score`` (the language's probability) of every whole text."""
    typed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *carried, F.col("text").cast("string").alias("text"))
    if model is None:
        return typed.select("doc_id", *carried, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    kinds = ", ".join(f"`{c}` {k}" for c, k in typed.dtypes[:-1])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        tables = net.pair_tables()
        for batch in words.slices(batches):
            texts = batch.column(1 + len(carried)).to_pylist()
            has = [i for i, t in enumerate(texts) if t and _LETTER.search(t)]
            label, score = ["und"] * len(texts), np.zeros(len(texts))
            a = 0
            while a < len(has):
                b, size = a, 0
                while b < len(has) and (b == a or size < 1 << 18):
                    size += len(texts[has[b]])
                    b += 1
                x, owner, weight = windows([texts[i].encode("utf-8", "replace") for i in has[a:b]])
                p = net.probabilities(x, tables) * weight[:, None]
                total = np.add.reduceat(p, np.flatnonzero(np.diff(owner, prepend=-1)), axis=0)
                total /= total.sum(axis=1, keepdims=True)
                for k, i in enumerate(has[a:b]):
                    label[i], score[i] = net.labels[int(total[k].argmax())], float(total[k].max())
                a = b
            yield pa.record_batch([*batch.columns[:-1], pa.array(label, pa.string()), pa.array(score)], names=["doc_id", *carried, "lang_pred", "score"])

    return typed.mapInArrow(run, f"{kinds}, lang_pred string, score double")
