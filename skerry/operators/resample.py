"""Resampling with draws that are a function of (seed, replicate, observation).

The draws are md5 numbers, so a replicate is the same on every partitioning and in every engine.
Replicates are aggregated before anything leaves the JVM.  Observations need a dense index 0, 1, ...
Each is drawn ``replicates`` times: draws are spread over tasks by their number, summed up where they are made, and
are never a side of a join that is sent to all.

Defined cases: a table without observations has no replicates and no intervals; values are taken as they are, nulls count
as observations without a value; equal values are told apart by their index.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skerry.functions.columns import draw, ratio, running
from skerry.functions.draws import CHUNK, digests
from skerry.functions.shared import written

SEED = 20260901
#: Draws of one task; observations that are sent to all tasks to be drawn from (more are shuffled).
DRAWS, HELD = 2_000_000, 1_000_000
#: Standard deviations around the expected place of a shuffle's cut within which hashes are put in order.
REACH = 6.0


def tasks_of(n: int, replicates: int) -> int:
    return max(1, -(-n * replicates // DRAWS))


def replicated(rows: DataFrame, replicates: DataFrame) -> DataFrame:
    """Every row beside every ``replicate``; the replicates are bounded by a parameter, the rows are not."""
    return rows.crossJoin(F.broadcast(replicates))


def numbers(rows: DataFrame, replicates: int) -> DataFrame:
    return rows.sparkSession.range(replicates).select(F.col("id").alias("replicate"))


def blocks_of(replicates: list[int], n: int) -> list[list[int]]:
    """Replicates that one task draws for a chunk of observations."""
    size = max(1, min(-(-len(replicates) // 16), DRAWS // max(1, min(n, CHUNK))))
    return [replicates[i : i + size] for i in range(0, len(replicates), size)]


def redrawn_sums(spark: SparkSession, parts: list[tuple[str, np.ndarray, np.ndarray]], replicates: int, seed: int) -> DataFrame:
    """(replicate, part, n, m, s, q): rows, values, their sum and that of their squares, of samples with replacement within each part.

    A part is what stands before the slot in its draws, its values by slot, and which of them are there: at most ``HELD``.
    """
    chunks = [(i, a) for i, (_, v, _) in enumerate(parts) for a in range(0, len(v), CHUNK)]
    blocks = blocks_of(list(range(replicates)), max(len(v) for _, v, _ in parts))
    shared = spark.sparkContext.broadcast((parts, chunks, blocks))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts, chunks, blocks = shared.value
        for pdf in batches:
            for piece in pdf["id"]:
                (part, a), block = chunks[piece // len(blocks)], blocks[piece % len(blocks)]
                label, v, there = parts[part]
                found = np.zeros((4, len(block)))
                for i, at, words in digests(np.arange(a, min(a + CHUNK, len(v))), [f"{seed}|{r}|{label}" for r in block]):
                    drawn = words[0].astype(np.int64) % len(v)
                    x = v[drawn]
                    found[:, i] += len(at), np.count_nonzero(there[drawn]), x.sum(), (x * x).sum()
                yield pd.DataFrame({"replicate": block, "part": part, "n": found[0].astype(int), "m": found[1].astype(int), "s": found[2], "q": found[3]})

    pieces = len(chunks) * len(blocks)
    found = spark.range(0, pieces, 1, min(pieces, 4096)).mapInPandas(run, "replicate long, part int, n long, m long, s double, q double")
    return found.groupBy("replicate", "part").agg(*(F.sum(c).alias(c) for c in "nmsq"))


def looked_up(drawn: DataFrame, held: DataFrame, key: str, n: int) -> DataFrame:
    """Draws with what was drawn; of the two sides only the ``n`` observations are ever built into a table."""
    return drawn.join(F.broadcast(held) if n <= HELD else held.hint("shuffle_hash"), key)


def indexed(df: DataFrame, key: str, *carried: str) -> DataFrame:
    """Rows with a dense index from 0 in order of ``key``, which must be unique; counted over ranges of the key."""
    rows = df.select(*dict.fromkeys([key, *carried]))
    return running(rows, [], [key], idx=("sum", F.lit(1))).withColumn("idx", (F.col("idx") - 1).cast("int"))


def statistic(name: str, value: str) -> Column:
    """One of mean, median, sd, minimum, maximum, iqr."""
    return {
        "mean": F.avg(value), "median": F.percentile(value, 0.5), "sd": F.coalesce(F.stddev_samp(value), F.lit(0.0)), "minimum": F.min(value), "maximum": F.max(value),
        "iqr": F.percentile(value, 0.75) - F.percentile(value, 0.25),
    }[name]


def bootstrap(rows: DataFrame, value: str, replicates: int, name: str = "mean", seed: int = SEED) -> DataFrame:
    """(replicate, statistic) of ``replicates`` samples with replacement from indexed rows."""
    n = rows.count()
    if not n:
        return rows.sparkSession.createDataFrame([], "replicate long, statistic double")
    if name == "mean" and n <= HELD:
        held = rows.select("idx", F.col(value).cast("double").alias("v"), F.col(value).isNotNull().alias("there")).toPandas().sort_values("idx")
        found = redrawn_sums(rows.sparkSession, [("", held["v"].where(held["there"], 0.0).to_numpy(float), held["there"].to_numpy(bool))], replicates, seed)
        return found.select("replicate", ratio(F.col("s"), F.col("m")).alias("statistic"))
    slots = rows.sparkSession.range(0, n, 1, tasks_of(n, replicates)).select(F.col("id").alias("slot"))
    drawn = replicated(slots, numbers(rows, replicates)).select("replicate", (draw(seed, F.col("replicate"), F.col("slot")) % n).cast("int").alias("idx"))
    return looked_up(drawn, rows.select("idx", value), "idx", n).groupBy("replicate").agg(statistic(name, value).alias("statistic"))


def percentile_interval(found: DataFrame, confidence: float = 0.95) -> DataFrame:
    tail = (1 - confidence) / 2
    q = F.percentile("statistic", F.array(F.lit(tail), F.lit(1 - tail)))
    return found.agg(q.alias("q"), F.stddev_samp("statistic").alias("se"), F.avg("statistic").alias("mean")).select(F.col("q")[0].alias("low"), F.col("q")[1].alias("high"), "se", "mean")


def bca_interval(rows: DataFrame, found: DataFrame, value: str, name: str = "mean", confidence: float = 0.95) -> tuple[float, float]:
    """Bias-corrected and accelerated interval: two quantiles of the replicates, shifted by the share below the estimate and the jackknife's skew."""
    from skerry.functions.special import normal_cdf, normal_quantile

    estimate = rows.agg(statistic(name, value).alias("e")).first()["e"]
    below, ties, size = found.agg(F.count_if(F.col("statistic") < estimate), F.count_if(F.col("statistic") == estimate), F.count("*")).first()
    left_out = jackknife(rows, value, name)
    mean = left_out.agg(F.avg("left_out").alias("m")).first()["m"]
    third, second = left_out.agg(F.sum(F.pow(F.lit(mean) - F.col("left_out"), 3.0)), F.sum(F.pow(F.lit(mean) - F.col("left_out"), 2.0))).first()
    share = min(max((below + ties / 2) / size, 0.5 / size), 1 - 0.5 / size)
    z0, a = normal_quantile(share), third / (6 * second**1.5) if second else 0.0
    at = []
    for p in ((1 - confidence) / 2, (1 + confidence) / 2):
        z = z0 + normal_quantile(p)
        at.append(normal_cdf(z0 + z / (1 - a * z)))
    q = found.agg(F.percentile("statistic", F.array(*map(F.lit, at))).alias("q")).first()["q"]
    return float(q[0]), float(q[1])


def jackknife(rows: DataFrame, value: str, name: str = "mean") -> DataFrame:
    """Each observation's statistic without it, and its influence.  Mean and sd have closed forms; median, iqr and extremes follow from a value's place among the sorted ones."""
    if name in ("mean", "sd"):
        s = rows.agg(F.count("*").alias("_n"), F.avg(value).alias("_m"), F.var_pop(value).alias("_var"))
        joined = rows.join(F.broadcast(s))  # one row
        n, x, m = F.col("_n").cast("double"), F.col(value), F.col("_m")
        left = F.col("_var") * n - (x - m) ** 2 * n / (n - 1)
        out = m + (m - x) / (n - 1) if name == "mean" else F.sqrt(F.greatest(left, F.lit(0.0)) / (n - 2))
        whole = m if name == "mean" else F.sqrt(F.col("_var") * n / (n - 1))
        return joined.where("_n > 2").select("idx", value, out.alias("left_out"), (whole - out).alias("influence"))
    # the j-th value without the one of place r is that of place j, or j + 1 from r on
    placed = running(rows.where(F.col(value).isNotNull()).select("idx", value, F.col(value).cast("double").alias("_v")), [], ["_v", "idx"], _place=("sum", F.lit(1))).withColumn("_place", F.col("_place") - 1)
    shares = {"median": [0.5], "minimum": [0.0], "maximum": [1.0], "iqr": [0.75, 0.25]}[name]
    n = placed.count()
    if n < 2:
        return placed.select("idx", value, F.lit(None).cast("double").alias("left_out"), F.lit(None).cast("double").alias("influence")).where("false")

    def ends(share: float, size: int) -> tuple[int, int, float]:
        at = share * (size - 1)
        return int(at), min(int(at) + 1, size - 1), at - int(at)

    needed = sorted({j + d for share in shares for j in ends(share, n - 1)[:2] for d in (0, 1)} | {j for share in shares for j in ends(share, n)[:2]})
    # one row with the few values that any answer needs
    picked = placed.agg(*(F.max(F.when(F.col("_place") == j, F.col("_v"))).alias(f"_x{j}") for j in needed))
    without = lambda j: F.when(F.col("_place") <= j, F.col(f"_x{j + 1}")).otherwise(F.col(f"_x{j}"))
    plain = lambda j: F.col(f"_x{j}")

    def quantile(share: float, size: int, value_of) -> Column:
        low, high, part = ends(share, size)
        return value_of(low) if part == 0 else value_of(low) + (value_of(high) - value_of(low)) * part

    out, whole = (quantile(shares[0], size, f) - (quantile(shares[1], size, f) if len(shares) > 1 else F.lit(0.0)) for size, f in ((n - 1, without), (n, plain)))
    return placed.join(F.broadcast(picked)).select("idx", value, out.alias("left_out"), (whole - out).alias("influence"))


def shuffle_test(rows: DataFrame, group: str, value: str, a: str, b: str, replicates: int, seed: int = SEED, name: str = "mean_difference") -> DataFrame:
    """Observed statistic and p of label shuffles: two-sided, (count + 1) / (replicates + 1), centre 1 for ratios, else 0."""
    two = rows.where(F.col(group).isin(a, b)).select("idx", group, value)
    n, n_a = two.agg(F.count("*"), F.count_if(F.col(group) == a)).first()
    combine = {
        "mean_difference": lambda p, q: F.avg(p) - F.avg(q), "median_difference": lambda p, q: F.percentile(p, 0.5) - F.percentile(q, 0.5), "ratio_of_means": lambda p, q: ratio(F.avg(p), F.avg(q)),
    }[name]
    centre = 1.0 if name == "ratio_of_means" else 0.0
    observed = two.agg(combine(F.when(F.col(group) == a, F.col(value)), F.when(F.col(group) == b, F.col(value))).alias("observed"))
    share, whole = n_a / max(n, 1), 1 << 32
    reach = REACH * (share * (1 - share) / max(n, 1)) ** 0.5
    ends = (0, whole) if name == "median_difference" else (max(0, int((share - reach) * whole)), min(whole, int((share + reach) * whole) + 1))
    null = written(_shuffled(two, value, list(range(replicates)), n, n_a, name, ends, seed), "shuffles")
    missed = [r["replicate"] for r in null.where("not settled").select("replicate").collect()]  # as a rule none
    if missed:
        null = null.where("settled").unionByName(_shuffled(two, value, missed, n, n_a, name, (0, whole), seed))
    extreme = F.abs(F.col("null") - centre) >= F.abs(F.col("observed") - centre) - 1e-9
    return null.join(F.broadcast(observed)).groupBy("observed").agg(((F.count_if(extreme) + 1) / F.lit(float(replicates + 1))).alias("p_value"))


def _shuffled(two: DataFrame, value: str, replicates: list[int], n: int, n_a: int, name: str, ends: tuple[int, int], seed: int) -> DataFrame:
    """(replicate, null, settled): the statistic with the ``n_a`` least hashes as first group.

    Rows whose hash begins below ``ends`` are summed up as first, those above as second; only the others are put in
    order.  A replicate whose cut is not between them is not settled.
    """
    blocks, (low, high) = blocks_of(replicates, n), ends

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        block, ids, v, there = blocks[key[1]], pdf["idx"].to_numpy(np.int64), pdf["v"].to_numpy(float), pdf["m"].to_numpy(bool)
        v, sums, near = np.where(there, v, 0.0), np.zeros((len(block), 3, 3)), []
        for i, at, words in digests(ids, [f"{seed}|{r}|" for r in block]):
            side = (words[0] >= low).astype(int) + (words[0] >= high)
            for k in (0, 2):
                own = at[side == k]
                sums[i, k] += len(own), np.count_nonzero(there[own]), v[own].sum()
            some = np.flatnonzero(side == 1)
            hi, lo = (((words[k][some].astype(np.uint64) << np.uint64(32) | words[k + 1][some]) ^ np.uint64(1 << 63)).view(np.int64) for k in (0, 2))
            own = at[some]
            near.append((np.full(len(own), block[i]), hi, lo, ids[own], there[own].astype(int), v[own]))
        r, hi, lo, idx, m, x = (np.concatenate(c) for c in zip(*near))
        parts = [pd.DataFrame({"replicate": r, "side": 1, "hi": hi, "lo": lo, "idx": idx, "n": 1, "m": m, "s": x})]
        for k in (0, 2):
            parts.append(pd.DataFrame({"replicate": block, "side": k, "hi": 0, "lo": 0, "idx": 0, "n": sums[:, k, 0].astype(int), "m": sums[:, k, 1].astype(int), "s": sums[:, k, 2]}))
        return pd.concat(parts, ignore_index=True)

    rows = two.select("idx", F.col(value).cast("double").alias("v"), F.col(value).isNotNull().alias("m"), F.floor(F.col("idx") / CHUNK).alias("chunk"))
    blocked = rows.crossJoin(F.broadcast(two.sparkSession.range(len(blocks)).select(F.col("id").alias("block"))))
    pieces = min(4096, (n // CHUNK + 1) * len(blocks))
    cells = blocked.repartition(pieces, "chunk", "block").groupBy("chunk", "block").applyInPandas(run, "replicate long, side int, hi long, lo long, idx long, n long, m long, s double")
    order = Window.partitionBy("replicate").orderBy("side", "hi", "lo", "idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cells = cells.withColumn("first", (F.sum("n").over(order) <= n_a) & (F.col("side") < 2))
    first, second = (lambda c: F.when(F.col("first"), F.col(c))), (lambda c: F.when(~F.col("first"), F.col(c)))
    if name == "median_difference":
        values = cells.where("n > 0").withColumn("v", F.when(F.col("m") > 0, F.col("s")))
        found, cells = F.percentile(first("v"), 0.5) - F.percentile(second("v"), 0.5), values
    else:
        p, q = (ratio(F.sum(side("s")), F.sum(side("m"))) for side in (first, second))
        found = ratio(p, q) if name == "ratio_of_means" else p - q
    settled = (F.coalesce(F.sum(first("n")), F.lit(0)) == n_a) & (F.coalesce(F.sum(F.when(F.col("side") == 0, F.col("n"))), F.lit(0)) <= n_a)
    return cells.groupBy("replicate").agg(found.alias("null"), settled.alias("settled"))


def monte_carlo_p(values: list[float], null: str = "normal", replicates: int = 9_999, seed: int = SEED) -> float:
    """Two-sided p of the sample's skewness against simulated normal, Poisson or uniform samples."""
    import numpy as np

    x = np.asarray([v for v in values if np.isfinite(v)], float)
    if len(x) < 5:
        raise ValueError("at least 5 finite values are needed")
    skew = lambda s: ((s - s.mean(-1, keepdims=True)) ** 3).mean(-1) / np.maximum(s.std(-1), 1e-12) ** 3
    rng = np.random.default_rng(seed)
    shape = (replicates, len(x))
    sample = {"normal": lambda: rng.normal(x.mean(), x.std(ddof=1), shape), "poisson": lambda: rng.poisson(max(x.mean(), 1e-9), shape).astype(float), "uniform": lambda: rng.uniform(x.min(), x.max(), shape)}[null]()
    drawn, observed = skew(sample), float(skew(x))
    return float(min(1.0, 2 * (min((drawn <= observed).sum(), (drawn >= observed).sum()) + 1) / (replicates + 1)))
