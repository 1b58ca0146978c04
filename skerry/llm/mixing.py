"""Mixing sources to target weights by temperature, in DataFrame functions only.

A source's share p of all tokens becomes the weight p^a / sum(p^a).  The exponent a in [0, 1] is
bisected: with a target entropy, to the greatest a whose normalised entropy reaches it; with a
repetition limit, to the least a at which no source is repeated more often.  Weights times the
budget are quotas.  A source's documents stand in an order drawn by hash; its quota is filled by
running through that order as often as needed, the last run ends where the quota does.  A copy's
place in its quota gives its block, so that every block holds each source at its weight; within a
block copies are permuted by hash.

Running sums have two levels: a source's order is cut into ranges of the hash, about ``RANGE_ROWS`` rows of the
whole table each and 256 at least, whose totals are summed first, so that no source meets in one task.

Defined cases: null or empty texts have 0 tokens and are taken while the quota isn't full; a null
source is a source of its own; equal ids share their place in the order, ties by token count; a null id has its
place by a hash of the row;
sources without tokens get no quota; an empty table gives no rows; clashing column names are kept
apart, the row travels as one struct.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skerry.llm.quality import let
from skerry.llm.shared import bounded

STEPS = 50
RANGE_ROWS, LEAST_BITS, MOST_BITS = 10_000, 8, 24
HASH_BITS = 60
MAX_BROADCAST_SUMS = 1_000_000


def hashed(*parts: Column) -> Column:
    """A number of 60 bits drawn from the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 15), 16, 10).cast("long")


def estimated_tokens(text: Column) -> Column:
    """A quarter of the bytes, rounded up."""
    return F.ceil(F.coalesce(F.octet_length(text.cast("string")), F.lit(0)) / 4.0).cast("long")


def _tempered(shares: Column, a: Column) -> Column:
    raised = F.transform(shares, lambda p: F.pow(p, a))
    return let(raised, lambda r: let(F.aggregate(r, F.lit(0.0), lambda s, x: s + x), lambda z: F.transform(r, lambda x: x / z)))


def _entropy(shares: Column, a: Column) -> Column:
    """Entropy of the weights over that of equal weights (1 for a single source)."""
    sum_of = lambda w: F.aggregate(w, F.lit(0.0), lambda s, x: s - x * F.ln(x))
    return F.when(F.size(shares) < 2, 1.0).otherwise(let(_tempered(shares, a), sum_of) / F.ln(F.size(shares)))


def weights(sources: DataFrame, target_entropy: float | None, max_repeats: float | None, budget: int | None) -> DataFrame:
    """``sources`` (source, held) with budget, exponent, weight and quota.  Rows are sources, one row holds them all."""
    total = sources.where("held > 0").agg(F.sort_array(F.collect_list(F.struct("source", "held"))).alias("all"), F.sum("held").alias("total"))
    total = total.withColumn("budget", F.lit(budget).cast("long") if budget is not None else F.col("total"))
    total = total.withColumn("shares", F.transform("all", lambda x: x["held"].cast("double") / F.col("total")))

    def low_enough(a: Column) -> Column:
        if max_repeats is None:
            return _entropy(F.col("shares"), a) >= F.lit(float(target_entropy))
        most = F.array_max(F.zip_with(_tempered(F.col("shares"), a), F.col("all"), lambda w, x: w * F.col("budget") / x["held"]))
        return most > F.lit(float(max_repeats))

    start = F.struct(F.lit(0.0).alias("low"), F.lit(1.0).alias("high"))

    def halve(x: Column, _: Column) -> Column:
        return let((x["low"] + x["high"]) / 2, lambda m: let(low_enough(m), lambda ok: F.struct(F.when(ok, m).otherwise(x["low"]).alias("low"), F.when(ok, x["high"]).otherwise(m).alias("high"))))

    end = "low" if max_repeats is None else "high"
    solved = total.withColumn("exponent", F.round(F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, halve)[end], 6))
    each = solved.select("budget", "exponent", F.explode(F.zip_with("all", _tempered(F.col("shares"), F.col("exponent")), lambda x, w: F.struct(x["source"].alias("source"), x["held"].alias("held"), F.round(w, 9).alias("weight")))).alias("x"))
    return each.select("x.*", "budget", "exponent", F.floor(F.col("x.weight") * F.col("budget")).cast("long").alias("quota"))


def mix(docs: DataFrame, target_entropy: float | None = 0.95, max_repeats: float | None = None, budget: int | None = None, block_tokens: int = 1_000_000, seed: int = 17, source_column: str = "source", id_column: str = "doc_id", tokens: Column | None = None, carry: bool = True) -> DataFrame:
    """The mixture, one row a copy: ``row`` (the document, or its id if not ``carry``), source, tokens, epoch, block, place.

    Give a target entropy (share of the greatest) or a repetition limit.  The budget is in tokens; without one it is all tokens.
    """
    if (target_entropy is None) == (max_repeats is None):
        raise ValueError("give a target entropy or a repetition limit")
    size = estimated_tokens(F.col("text")) if tokens is None else tokens
    row = F.struct(*(F.col(c) for c in (docs.columns if carry else [id_column]))).alias("row")
    name = F.coalesce(F.col(id_column).cast("string"), F.concat(F.lit("row "), F.xxhash64(*docs.columns).cast("string")))
    bits = min(max(LEAST_BITS, math.ceil(math.log2(max(1, docs.count()) / RANGE_ROWS))), MOST_BITS)
    base = docs.select(row, F.col(source_column).cast("string").alias("source"), size.alias("tokens"), hashed(F.lit(str(seed)), name).alias("h"), name.alias("name"))
    base = base.withColumn("bucket", F.shiftright("h", HASH_BITS - bits).cast("int"))
    sums = base.groupBy("source", "bucket").agg(F.sum("tokens").alias("in_bucket"))
    before = F.sum("in_bucket").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("in_bucket")
    sources = weights(sums.groupBy("source").agg(F.sum("in_bucket").alias("held")), target_entropy, max_repeats, budget)
    known = sums.withColumn("before", before).join(sources.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    known = bounded(known.withColumnsRenamed({"source": "of", "bucket": "range"}), MAX_BROADCAST_SUMS)
    order = Window.partitionBy("source", "bucket").orderBy("h", F.col(f"row.{id_column}"), "tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = base.withColumn("upto", F.sum("tokens").over(order)).join(known, F.col("source").eqNullSafe(F.col("of")) & (F.col("bucket") == F.col("range")))
    placed = placed.withColumn("start", F.col("before") + F.col("upto") - F.col("tokens")).where("start < quota")
    runs = F.sequence(F.lit(0).cast("long"), F.floor((F.col("quota") - F.col("start") - 1) / F.col("held")).cast("long"))
    copies = placed.withColumn("epoch", F.explode(runs)).withColumn("at", F.col("epoch") * F.col("held") + F.col("start"))
    blocks = F.ceil(F.col("budget") / float(block_tokens))
    copies = copies.withColumn("block", F.floor(F.col("at").cast("double") / F.col("quota").cast("double") * blocks).cast("long"))
    copies = copies.withColumn("drawn", hashed(F.lit(str(seed + 1)), F.col("epoch").cast("string"), F.col("name")))
    place = F.row_number().over(Window.partitionBy("block").orderBy("drawn", F.col(f"row.{id_column}"), "source", "at")).cast("long")
    return copies.withColumn("place", place).select("row", "source", "tokens", "epoch", "block", "place")
