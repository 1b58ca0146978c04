"""Toxicity: class-conditional Kneser-Ney models, compared by length-normalised log-likelihood.

An expression w is a run of letters (ASCII letters without case, and all bytes above 127); its stem s is
its first 4 characters, its history the stem of the expression before it (or a mark at the text's start).  As in
Kneser-Ney's lower orders, everything is counted in different histories: N_c(w) of the histories that
documents of class c have before w, N(w) of those that either class has.  So what one text repeats, or copies
of it, count once.  With D the discount, and sums over w without an argument,

    P_c(w) = max(N_c(w) - D, 0) / N_c  +  L_c * R_c(s) * N(w) / N(s)
    R_c(s) = max(N_c(s) - D, 0) / N_c  +  M_c * N(s) / (N + 1)

where L_c and M_c are what the discounts have left over, and N(.) is the backoff that both classes share: a rare
expression has nearly the same probability in either class and says little.  What no document has shares
1 / (N + 1), so that probabilities sum to 1.

Most expressions of a toxic document are ordinary: its model takes the share ``TOXIC_SHARE`` of them from the
toxic class and the others from the ordinary one.  A text's log-likelihoods under the two models, divided by
its expressions, are compared; a logistic curve over their difference alone, fitted on labelled rows that the
counts left out (on the counted ones if those are of one class), gives the score.

Counts are distinct (expression, history) pairs by groupBy, from every labelled training row; expressions and
stems are told apart by 64-bit hashes, histories by 32 bits.  The
model keeps expressions of more than D histories in a class; others need no entry, as their probabilities' ratio
doesn't depend on them.  Up to ``MAX_BROADCAST_WORDS`` entries it is broadcast.  With more, each different expression of the corpus is joined with
it once; the commonest of them, at most ``MAX_BROADCAST_WORDS`` by their share of all texts' expressions, are broadcast and
summed up where the text is read, and only the rest is shuffled, in which no expression is common.  The result is the same.

Defined cases: a null or empty text, or one without letters, has difference 0 and gets the curve's value there;
without labelled rows of both classes every score is 0.0; repeated rows are scored alike; rows with a null
id are scored and count as training rows of no label; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.llm import words
from skerry.llm.shared import bounded, stage

STEM_CHARACTERS = 4
DISCOUNT = 1.5
TOXIC_SHARE = 0.001
#: Labelled rows that are broadcast; with more, Spark shuffles both sides.
MAX_BROADCAST_LABELS = 1_000_000
#: Entries of the model that are broadcast, 48 bytes each.
MAX_BROADCAST_WORDS = 1_000_000

_SPACE = np.ones(256, bool)
_SPACE[65:91] = _SPACE[97:123] = _SPACE[128:] = False
_FIRST = (np.arange(256) & 0xC0) != 0x80  # bytes that begin a character


def expressions(raws: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all expressions in order: hashes of the word, its stem and the stem before (0 at a start); and where each text's begin."""
    joined = np.frombuffer(b"\n".join(raws) + b"\n", np.uint8)
    ends_at = np.cumsum(np.fromiter((len(r) + 1 for r in raws), np.int64, len(raws)))
    edge = np.diff(_SPACE[joined].view(np.int8), prepend=np.int8(1))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge[1:] == 1) + 1
    total, down = words.running_hash(joined)
    characters = np.flatnonzero(_FIRST[joined])
    after = np.searchsorted(characters, starts) + STEM_CHARACTERS
    cut = np.minimum(characters[np.minimum(after, len(characters) - 1)], ends)
    word, stem = (words.mix((total[to] - total[starts]) * down[starts] + (to - starts).astype(np.uint64)).view(np.int64) for to in (ends, cut))
    at = np.concatenate(([0], np.searchsorted(starts, ends_at)))
    before = np.zeros(len(stem), np.int32)
    before[1:] = stem[:-1].astype(np.int32)
    before[at[:-1][np.diff(at) > 0]] = 0
    return word, stem, before, at


@dataclass
class KneserNey:
    """Entries of words (sorted by hash) and stems, each with a row per class (0 ordinary, 1 toxic)."""

    words: np.ndarray
    mass: np.ndarray  # max(N_c(w) - D, 0) / N_c
    within: np.ndarray  # N(w) / N(s)
    stems: np.ndarray
    stem_p: np.ndarray  # R_c(s)
    left: np.ndarray  # L_c
    stem_left: np.ndarray  # M_c

    def ratio(self, word: np.ndarray, stem: np.ndarray) -> np.ndarray:
        """The toxic class's probability of each expression over the ordinary one's."""
        entry = _find(self.words, word, np.vstack([self.mass, self.within]), [0.0, 0.0, 1.0])
        p = entry[:, :2] + self.left * _find(self.stems, stem, self.stem_p, self.stem_left) * entry[:, 2:]
        return p[:, 1] / p[:, 0]

    def differences(self, raws: Sequence[bytes]) -> np.ndarray:
        """Per text: log-likelihood an expression under the toxic document's model less that under the ordinary one."""
        word, stem, _, at = expressions(raws)
        total = np.concatenate(([0.0], np.cumsum(np.log1p(TOXIC_SHARE * (self.ratio(word, stem) - 1)))))
        return (total[at[1:]] - total[at[:-1]]) / np.maximum(np.diff(at), 1)


def _find(keys: np.ndarray, wanted: np.ndarray, values: np.ndarray, otherwise) -> np.ndarray:
    """Columns of ``values`` at the keys wanted, one row each; ``otherwise`` where there is no such key."""
    at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
    if not len(keys):
        return np.tile(np.asarray(otherwise, float), (len(wanted), 1))
    return np.where((keys[at] == wanted)[:, None], values[:, at].T, np.asarray(otherwise, float))


@dataclass
class Model:
    """The language models, as a broadcast ``language`` or as tables of entries, and the curve over their difference."""

    language: KneserNey | None
    tables: tuple[DataFrame, DataFrame, np.ndarray, np.ndarray]
    weights: np.ndarray

    def curve(self, difference: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.weights[0] + self.weights[1] * difference / TOXIC_SHARE, -30, 30)))


def fit_curve(difference: np.ndarray, labels: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Level and slope of a logistic curve, by Newton steps with a small ridge on the slope."""
    x, y = np.column_stack([np.ones(len(difference)), difference / TOXIC_SHARE]), labels.astype(float)
    w, penalty = np.zeros(2), np.diag([1e-9, ridge])
    for _ in range(100):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty + 1e-9 * np.eye(2), x.T @ (y - p) - penalty @ w)
        w += step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return w


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Different (word, stem, before) of a run of texts, and the classes (bits) that have them."""
    for batch in batches:
        bits = 1 << np.asarray(batch.column(1).to_pylist(), np.int64)
        for first, raws in words.chunks(batch.column(0).to_pylist()):
            word, stem, before, at = expressions(raws)
            if not len(word):
                continue
            bit = np.repeat(bits[first : first + len(raws)], np.diff(at))
            order = np.lexsort((before, word))
            word, stem, before, bit = word[order], stem[order], before[order], bit[order]
            cut = np.flatnonzero(np.concatenate(([True], (word[1:] != word[:-1]) | (before[1:] != before[:-1]))))
            yield pa.record_batch([pa.array(word[cut]), pa.array(stem[cut]), pa.array(before[cut]), pa.array(np.bitwise_or.reduceat(bit, cut))], names=["word", "stem", "before", "classes"])


def counted(rows: DataFrame) -> DataFrame:
    """(word, stem, ordinary, toxic, shared): different histories of every expression of (text, label) rows."""
    pairs = rows.select("text", "label").mapInArrow(_contexts, "word long, stem long, before int, classes long")
    pairs = pairs.groupBy("word", "stem", "before").agg(F.bit_or("classes").alias("classes"))
    of = lambda c: F.count_if(F.col("classes").bitwiseAND(1 << c) > 0)
    return pairs.groupBy("word", "stem").agg(of(0).alias("ordinary"), of(1).alias("toxic"), F.count("*").alias("shared"))


def entries(counts: DataFrame) -> tuple[DataFrame, DataFrame, np.ndarray, np.ndarray] | None:
    """Tables of words and stems that the model needs, and what each class's discounts leave; None without both classes."""
    cut = lambda c: F.least(F.col(c), F.lit(DISCOUNT))
    stems = stage(counts.groupBy("stem").agg(*(F.sum(c).alias(c) for c in ("ordinary", "toxic", "shared"))), "toxic-stems")
    of_words = counts.agg(*(F.sum(c) for c in ("ordinary", "toxic", "shared")), *(F.sum(cut(c)) for c in ("ordinary", "toxic"))).first()
    of_stems = stems.agg(*(F.sum(cut(c)) for c in ("ordinary", "toxic"))).first()
    if not of_words[0] or not of_words[1]:
        return None
    total, everything = np.array(of_words[:2], float), float(of_words[2])
    left, stem_left = np.array(of_words[3:5], float) / total, np.array(of_stems, float) / total
    mass = [F.greatest(F.col(c) - DISCOUNT, F.lit(0.0)) / float(t) for c, t in zip(("ordinary", "toxic"), total)]
    kept = (F.col("ordinary") > DISCOUNT) | (F.col("toxic") > DISCOUNT)
    share = F.col("shared") / (everything + 1)
    stem_rows = stems.where(kept).select("stem", *((m + float(x) * share).alias(f"r_{c}") for m, x, c in zip(mass, stem_left, "ot")))
    word_rows = counts.where(kept).join(stems.select("stem", F.col("shared").alias("_all")), "stem").select("word", *(m.alias(f"m_{c}") for m, c in zip(mass, "ot")), (F.col("shared") / F.col("_all")).alias("within"))
    return stage(word_rows, "toxic-words"), stage(stem_rows, "toxic-stem-rows"), left, stem_left


def gathered(tables) -> KneserNey | None:
    """The model as arrays, if it is small enough to be broadcast."""
    word_rows, stem_rows, left, stem_left = tables
    if word_rows.count() + stem_rows.count() > MAX_BROADCAST_WORDS:
        return None
    w, s = word_rows.toPandas().sort_values("word"), stem_rows.toPandas().sort_values("stem")
    return KneserNey(w["word"].to_numpy(), w[["m_o", "m_t"]].to_numpy().T.copy(), w["within"].to_numpy(), s["stem"].to_numpy(), s[["r_o", "r_t"]].to_numpy().T.copy(), left, stem_left)


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Different expressions of each text: (batch, row, word, stem, number)."""
    for batch in batches:
        for first, raws in words.chunks(batch.column(batch.num_columns - 1).to_pylist()):
            word, stem, _, at = expressions(raws)
            owner = np.repeat(np.arange(len(raws)), np.diff(at))
            order = np.lexsort((word, owner))
            word, stem, owner = word[order], stem[order], owner[order]
            cut = np.flatnonzero(np.concatenate(([True], (word[1:] != word[:-1]) | (owner[1:] != owner[:-1])))) if len(word) else np.empty(0, np.int64)
            yield batch, owner[cut] + first, word[cut], stem[cut], np.diff(np.append(cut, len(word)))


def _seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, stem, texts) of the different expressions of a run of texts."""
    for _, _, word, stem, _ in _split(batches):
        order = np.argsort(word, kind="stable")
        word, stem = word[order], stem[order]
        cut = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1]))) if len(word) else np.empty(0, np.int64)
        yield pa.record_batch([pa.array(word[cut]), pa.array(stem[cut]), pa.array(np.diff(np.append(cut, len(word))))], names=["word", "stem", "texts"])


def evidence(docs: DataFrame, tables) -> DataFrame:
    """(word, texts, e) of every different expression of ``docs``: in how many texts it is, and its share in their differences."""
    word_rows, stem_rows, left, stem_left = tables
    seen = docs.select("text").mapInArrow(_seen, "word long, stem long, texts long").groupBy("word", "stem").agg(F.sum("texts").alias("texts"))
    p = [F.coalesce(f"m_{c}", F.lit(0.0)) + float(a) * F.coalesce(f"r_{c}", F.lit(float(b))) * F.coalesce("within", F.lit(1.0)) for c, a, b in zip("ot", left, stem_left)]
    found = seen.join(word_rows, "word", "left").join(stem_rows, "stem", "left")
    return stage(found.select("word", "texts", F.log1p(TOXIC_SHARE * (p[1] / p[0] - 1)).alias("e")), "toxic-evidence")


def _joined(docs: DataFrame, tables, *carried: str) -> DataFrame:
    """``differences`` with a model that is too large to be broadcast."""
    rows = docs.select(*carried, F.xxhash64("text").alias("_digest"), "text")
    known = evidence(rows, tables)
    total = known.agg(F.sum("texts")).first()[0] or 0
    # at most so many words can have this share of all
    common = known.where(F.col("texts") * MAX_BROADCAST_WORDS >= total)
    top = common.select("word", "e").toPandas().sort_values("word")
    shared = docs.sparkSession.sparkContext.broadcast((top["word"].to_numpy(np.int64), top["e"].to_numpy(float)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed, e = shared.value
        for batch, row, word, _, n in _split(batches):
            at = np.minimum(np.searchsorted(listed, word), max(0, len(listed) - 1))
            hit = listed[at] == word if len(listed) else np.zeros(len(word), bool)
            texts, owner = np.unique(row, return_inverse=True)
            size, part = (np.bincount(o, v, len(texts)).astype(float) for o, v in ((owner, n), (owner[hit], n[hit] * e[at[hit]])))
            rest = row[~hit]
            key = pa.array(np.concatenate([texts, rest]))
            absent, none = pa.nulls(len(texts), pa.int64()), pa.array(np.zeros(len(rest)))
            yield pa.record_batch(
                [batch.column(0).take(key), batch.column(1).take(key), pa.concat_arrays([absent, pa.array(word[~hit])]), pa.concat_arrays([pa.array(size), none]), pa.concat_arrays([pa.array(part), pa.array(n[~hit].astype(float))])],
                names=["key", "digest", "word", "size", "part"],
            )

    tokens = rows.select(F.col(carried[0]).cast("long").alias("key"), F.col("_digest").alias("digest"), "text").mapInArrow(run, "key long, digest long, word long, size double, part double")
    sums = lambda t, e: t.groupBy("key", "digest").agg(F.sum("size").alias("size"), F.sum(e).alias("part"))
    rare = known.where(F.col("texts") * MAX_BROADCAST_WORDS < total).select("word", "e")
    both = stage(tokens, "toxic-tokens")
    whole = sums(both.where("word is null"), F.col("part")).unionByName(sums(both.where("word is not null").join(rare, "word"), F.col("part") * F.col("e")))
    found = whole.groupBy("key", "digest").agg((F.sum("part") / F.sum("size")).alias("_difference"))
    match = F.col(carried[0]).eqNullSafe(F.col("key")) & (F.col("_digest") == F.col("digest"))
    return rows.drop("text").join(found, match, "left").select(*carried, F.coalesce("_difference", F.lit(0.0)).alias("difference"))


def differences(docs: DataFrame, tables, language: KneserNey | None, *carried: str) -> DataFrame:
    """``carried`` columns and ``difference`` of every row's text."""
    if language is None:
        return _joined(docs, tables, *carried)
    shared = docs.sparkSession.sparkContext.broadcast(language)
    kinds = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, raws in words.chunks(batch.column(len(carried)).to_pylist()):
                yield pa.record_batch([*(batch.column(k).slice(first, len(raws)) for k in range(len(carried))), pa.array(shared.value.differences(raws))], names=[*carried, "difference"])

    return docs.select(*carried, "text").mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in carried), "difference double"]))


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Text, label and fold of the rows that may be learnt from (fold 0 is held out)."""
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    known = known.withColumn("fold", F.crc32(F.col("doc_id").cast("string")) % 5).where("fold <> 0")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(bounded(known, MAX_BROADCAST_LABELS), "doc_id")


def fit(docs: DataFrame, labels: DataFrame, max_curve_rows: int = 20_000) -> Model | None:
    """Count over every labelled row of folds 1 to 3, fit the curve on at most ``max_curve_rows`` rows of fold 4."""
    rows = _labelled(docs, labels)
    tables = entries(stage(counted(rows.where("fold <> 4")), "toxic-counts"))
    if tables is None:
        return None
    language = gathered(tables)
    share = max_curve_rows / max(1, labels.where("doc_id is not null").count() / 5)
    for fold in ("fold = 4", "fold <> 4"):
        held = rows.where(fold)
        if share < 1:
            held = held.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
        curve = differences(held, tables, language, "doc_id", "label").orderBy(F.xxhash64("doc_id"), "difference").limit(max_curve_rows).toPandas()
        y = curve["label"].to_numpy()
        if len(y) and y.min() != y.max():
            return Model(language, tables, fit_curve(curve["difference"].to_numpy(), y))
    return None


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id`` and ``score`` (0 to 1, higher: toxic is likelier) of every whole text."""
    if model is None:
        return docs.select("doc_id", F.lit(0.0).alias("score"))
    typed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    z = F.lit(float(model.weights[0])) + F.lit(float(model.weights[1])) * F.col("difference") / TOXIC_SHARE
    return differences(typed, model.tables, model.language, "doc_id").select("doc_id", (1.0 / (1.0 + F.exp(-F.least(F.greatest(z, F.lit(-30.0)), F.lit(30.0))))).alias("score"))
