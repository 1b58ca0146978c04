"""Exact quantiles of groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.functions.columns import null_safe, running_sum

#: Values of a group that one task may hold; in larger groups the places of values are counted over all tasks.
HELD = 200_000


def quantiles(df: DataFrame, by: Sequence[str], value: str, shares: Sequence[float], to: str = "q") -> DataFrame:
    """(by, ``to``): an array of the linear quantiles of the finite or infinite ``value`` in each group; nulls are left out.

    A quantile lies between two values whose places are known from n.  Small groups are sorted in a task; if one has
    more than ``HELD`` values, equal values are counted, the counts are summed up in order over ranges of the value, and the
    values at those places are picked.  Null keys are groups of their own; an empty table has no groups.
    """
    keys = [f"_q_{i}" for i in range(len(by))]
    rows = df.where(F.col(value).isNotNull()).select(*(F.col(c).alias(k) for c, k in zip(by, keys)), F.col(value).cast("double").alias("_q_v"))
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_q_n"))
    largest = sizes.agg(F.max("_q_n")).first()[0] or 0
    names = [F.col(k).alias(c) for c, k in zip(by, keys)]
    if largest <= HELD:
        return rows.groupBy(*keys).agg(F.percentile("_q_v", F.array(*(F.lit(float(s)) for s in shares))).alias(to)).select(*names, to)
    cells = rows.groupBy(*keys, "_q_v").agg(F.count("*").alias("_q_c"))
    placed = running_sum(cells, keys, ["_q_v"], "_q_c", "_q_upto")
    other = sizes.select(*(F.col(k).alias(f"{k}_s") for k in keys), "_q_n")
    placed = placed.join(other, null_safe([(k, f"{k}_s") for k in keys]))
    parts = []
    for i, share in enumerate(shares):
        at = F.lit(float(share)) * (F.col("_q_n") - 1)
        for end, place in (("l", F.floor(at)), ("h", F.ceil(at))):
            parts.append(F.max(F.when((F.col("_q_upto") - F.col("_q_c") <= place) & (place < F.col("_q_upto")), F.col("_q_v"))).alias(f"_q_{end}{i}"))
    found = placed.groupBy(*keys, "_q_n").agg(*parts)
    between = lambda i, s: F.col(f"_q_l{i}") + (F.col(f"_q_h{i}") - F.col(f"_q_l{i}")) * (F.lit(float(s)) * (F.col("_q_n") - 1) - F.floor(F.lit(float(s)) * (F.col("_q_n") - 1)))
    return found.select(*names, F.array(*(F.when(F.col(f"_q_l{i}") == F.col(f"_q_h{i}"), F.col(f"_q_l{i}")).otherwise(between(i, s)) for i, s in enumerate(shares))).alias(to))
