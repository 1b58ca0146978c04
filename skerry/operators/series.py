"""Paired series and trends: correlation, lines, Mann-Kendall, Theil-Sen, growth descriptors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skerry.functions import trends
from skerry.functions.columns import finite, null_safe, ratio, running_sum
from skerry.functions.quantiles import quantiles
from skerry.functions.shared import written


def line(df: DataFrame, x: str, y: str, *by: str) -> DataFrame:
    """Pearson's r and the least-squares line, in one pass."""
    return finite(df, x, y).groupBy(*by).agg(F.count("*").alias("n"), F.corr(x, y).alias("pearson"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))


def _ranked(df: DataFrame, column: str) -> DataFrame:
    values = running_sum(df.groupBy(column).agg(F.sum("_n").alias("_t")), [], [column], "_t", "_upto")
    return values.select(column, (F.col("_upto") - F.col("_t") + (F.col("_t") + 1) / 2.0).alias(f"_rank_{column}"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Correlation of mid-ranks.  Pairs are counted first, so repeated pairs travel once."""
    rows = finite(df, x, y).groupBy(x, y).agg(F.count("*").alias("_n")).persist()
    counts = rows.join(_ranked(rows, x), x).join(_ranked(rows, y), y)
    a, b, w = F.col(f"_rank_{x}"), F.col(f"_rank_{y}"), F.col("_n")
    s = counts.agg(F.sum(w).alias("n"), F.sum(w * a).alias("a"), F.sum(w * b).alias("b"), F.sum(w * a * b).alias("ab"), F.sum(w * a * a).alias("aa"), F.sum(w * b * b).alias("bb"))
    n = F.col("n").cast("double")
    r = ratio(n * F.col("ab") - F.col("a") * F.col("b"), F.sqrt((n * F.col("aa") - F.col("a") * F.col("a")) * (n * F.col("bb") - F.col("b") * F.col("b"))))
    return s.select("n", r.alias("spearman"))


#: Points of a series that one task holds; longer ones are counted block by block.
BLOCK = 65_536
SAMPLED, MOST_PASSES = 4096, 80
NORMAL_95 = 1.959963984540054
_POINT = "_k string, _p int, _kind int, _block long, _range long, _n long, _x double, _y double"


def _statistics(n: int, tied_x: int, tied_v: int, tied_both: int, term: int, under: int) -> tuple:
    """n, pairs with different x, score, variance and tau-b from counts of pairs."""
    pairs = n * (n - 1) // 2
    score = pairs - tied_x - (tied_v - tied_both) - 2 * under
    spread = float(pairs - tied_v) * pairs
    return n, pairs - tied_x, float(score), (n * (n - 1) * (2 * n + 5) - term) / 18, score / spread**0.5 if spread > 0 else 0.0


def _ranks(pairs: int, variance: float) -> list[int]:
    """Ranks of the two middle slopes and of the ends of the 95 % interval."""
    reach = NORMAL_95 * max(variance, 0.0) ** 0.5
    return [(pairs + 1) // 2, pairs // 2 + 1, max(1, round((pairs - reach) / 2)), min(round((pairs + reach) / 2), pairs)]


def _short(rows: DataFrame, sloped: bool) -> DataFrame:
    """Statistics of series that a task holds."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf["_x"].to_numpy(), pdf["_y"].to_numpy()
        t = np.unique(y, return_counts=True)[1].astype(object)
        found = _statistics(len(x), trends.tied_pairs(x), trends.tied_pairs(y), trends.tied_pairs(x, y), int((t * (t - 1) * (2 * t + 5)).sum()), trends.discordant(x, y))
        slopes = trends.select(x, y, _ranks(found[1], found[3])) if sloped and found[1] else [np.nan] * 4
        return pd.DataFrame([(*key, *found, slopes)], columns=["_k", *_FOUND])

    return rows.groupBy("_k").applyInPandas(run, _SCHEMA)


_FOUND = ["n", "pairs", "score", "variance", "tau_b", "slopes"]
_SCHEMA = "_k string, n long, pairs long, score double, variance double, tau_b double, slopes array<double>"


def _under(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """(_k, s, under, near): for each asked value how many slopes are less, and slopes of the data next to it.

    ``rows`` (_k, _x, _y, _block), ``asked`` (_k, n, asked, xs, ys).  Pairs within a block are counted by its task.  Each value
    cuts z = y - s x into ranges, by the series' sample; pairs of different blocks in one range are counted by that range's
    task, pairs that differ in both from a table of counts.  A value that many rows share is a range of its own, without
    discordant pairs, and stays at home.
    """
    # names of their own, as both sides of the cogroup come from the same rows
    blocks = rows.select("_k", "_block").distinct().join(asked, "_k").withColumnsRenamed({"_k": "_key", "_block": "_place"})

    def home(points: pd.DataFrame, task: pd.DataFrame) -> pd.DataFrame:
        if points.empty or task.empty:
            return pd.DataFrame(columns=_POINT.replace(",", "").split()[::2])
        key, block = points["_k"].iloc[0], int(points["_block"].iloc[0])
        x, y, t, out = points["_x"].to_numpy(), points["_y"].to_numpy(), task.iloc[0], []
        xs, ys, cuts = np.asarray(t["xs"]), np.asarray(t["ys"]), max(2, 2 * -(-int(t["n"]) // BLOCK))
        for p, s in enumerate(t["asked"]):
            z = y - s * x
            bounds = np.unique(np.quantile(ys - s * xs, np.linspace(0, 1, cuts + 1)[1:-1], method="lower"))
            at = np.searchsorted(bounds, z)
            own = 2 * at + (bounds[np.minimum(at, len(bounds) - 1)] == z)
            ranges, sizes = np.unique(own, return_counts=True)
            inner = trends.discordant(x, z) if block % 2 == 0 else 0
            out.append(pd.DataFrame({"_k": key, "_p": p, "_kind": [0] + [1] * len(ranges), "_block": block, "_range": [-1, *ranges], "_n": [inner, *sizes], "_x": np.nan, "_y": np.nan}))
            far = own % 2 == 0
            out.append(pd.DataFrame({"_k": key, "_p": p, "_kind": 2, "_block": block, "_range": own[far], "_n": 0, "_x": x[far], "_y": y[far]}))
        return pd.concat(out, ignore_index=True)

    dealt = written(rows.groupBy("_k", "_block").cogroup(blocks.groupBy("_key", "_place")).applyInPandas(home, _POINT), "trend-points")
    values = asked.select("_k", F.posexplode("asked").alias("_p", "s"))

    def across(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        # cells of later blocks and lower ranges, by sums over the table of counts
        b, bi = np.unique(pdf["_block"], return_inverse=True)
        g, gi = np.unique(pdf["_range"], return_inverse=True)
        table = np.zeros((len(b), len(g)), np.int64)
        np.add.at(table, (bi, gi), pdf["_n"].to_numpy())
        later = np.cumsum(table[::-1], axis=0)[::-1]
        lower = np.cumsum(later, axis=1)
        beyond = sum(int(x) for x in (table[:-1, 1:].astype(object) * lower[1:, :-1].astype(object)).ravel()) if len(b) > 1 and len(g) > 1 else 0
        return pd.DataFrame([(*key, beyond, [])], columns=["_k", "_p", "under", "near"])

    def within(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x, y, s = pdf["_x"].to_numpy(), pdf["_y"].to_numpy(), pdf["s"].iloc[0]
        near = trends.neighbours(x, y, s)
        near = near[np.argsort(np.abs(near - s))[:8]]
        return pd.DataFrame([(*key[:2], trends.discordant(pdf["_block"].to_numpy(), y - s * x), near.tolist())], columns=["_k", "_p", "under", "near"])

    part = "_k string, _p int, under long, near array<double>"
    inner = dealt.where("_kind = 0").select("_k", "_p", F.col("_n").alias("under"), F.array().cast("array<double>").alias("near"))
    crossed = dealt.where("_kind = 1").groupBy("_k", "_p").applyInPandas(across, part)
    ranged = dealt.where("_kind = 2").join(values, ["_k", "_p"]).groupBy("_k", "_p", "_range").applyInPandas(within, part)
    total = inner.unionByName(crossed).unionByName(ranged).groupBy("_k", "_p").agg(F.sum("under").alias("under"), F.flatten(F.collect_list("near")).alias("near"))
    return total.join(values, ["_k", "_p"]).select("_k", "s", "under", "near")


def _long(rows: DataFrame, sloped: bool) -> DataFrame:
    """Statistics of series of any length, by counting passes over their blocks."""
    tied = lambda *c: rows.groupBy("_k", *c).agg(F.count("*").alias("_c"))
    c, pairs = F.col("_c").cast("decimal(38,0)"), F.sum(F.expr("cast(_c as decimal(19,0)) * (_c - 1) / 2").cast("decimal(38,0)"))
    by_x = written(running_sum(tied("_x"), ["_k"], ["_x"], "_c", "_upto"), "trend-order")
    start = F.col("_upto") - F.col("_c")
    # a value of x that fills a block by itself has no discordant pairs inside
    block = 2 * F.floor(start / BLOCK) + (F.col("_c") >= BLOCK).cast("long")
    placed = written(rows.join(by_x.select(F.col("_k").alias("_k2"), F.col("_x").alias("_x2"), block.alias("_block")), (F.col("_k") == F.col("_k2")) & (F.col("_x") == F.col("_x2"))).select("_k", "_x", "_y", "_block"), "trend-blocks")
    ties = by_x.groupBy("_k").agg(F.sum("_c").alias("n"), pairs.alias("tx"))
    for name, columns in (("tv", ["_y"]), ("tb", ["_x", "_y"])):
        ties = ties.join(tied(*columns).groupBy("_k").agg(pairs.alias(name)), "_k")
    ties = ties.join(tied("_y").groupBy("_k").agg(F.sum((c * (c - 1)) * (2 * c + 5)).cast("decimal(38,0)").alias("term")), "_k")
    points = placed.join(ties.select("_k", "n"), "_k").where(F.pmod(F.xxhash64("_x", "_y"), F.greatest(F.lit(1), F.floor(F.col("n") / SAMPLED))) == 0).select("_k", "_x", "_y").distinct()
    sample = points.groupBy("_k").agg(F.collect_list("_x").alias("xs"), F.collect_list("_y").alias("ys"))
    known = written(ties.join(sample, "_k", "left"), "trend-series")
    empty = F.array().cast("array<double>")
    base = known.select("_k", "n", F.array(F.lit(0.0)).alias("asked"), F.coalesce("xs", empty).alias("xs"), F.coalesce("ys", empty).alias("ys"))
    level = written(_under(placed, base), "trend-score")

    def judged(pdf: pd.DataFrame) -> list[tuple]:
        return [_statistics(int(r.n), int(r.tx), int(r.tv), int(r.tb), int(r.term), int(r.under)) for r in pdf.itertuples()]

    def first(batches):
        for pdf in batches:
            yield pd.DataFrame([(k, *t, [np.nan] * 4) for k, t in zip(pdf["_k"], judged(pdf))], columns=["_k", *_FOUND])

    text = [F.col(x).cast("string").alias(x) for x in ("tx", "tv", "tb", "term")]
    scored = written(known.join(level.select("_k", "under"), "_k").select("_k", "n", *text, "under").mapInPandas(first, _SCHEMA), "trend-scores")
    if not sloped:
        return scored
    state_of = "_k string, _rank int, k long, low double, high double, under_low long, under_high long, grain double, near array<double>, asked array<double>, slope double"

    def searches(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                if not r.pairs:
                    continue
                xs, ys = np.asarray(r.xs, float), np.asarray(r.ys, float)
                near, small = trends.drawn(xs, ys), trends.grain(xs, ys)
                for i, k in enumerate(_ranks(r.pairs, r.variance)):
                    search = trends.Search(k, r.pairs, small)
                    out.append((r._1, i, k, search.low, search.high, 0, r.pairs, small, near.tolist(), search.probes(near), None))
            yield pd.DataFrame(out, columns=state_of.replace(",", "").split()[::2])

    def advance(state: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
        out = []
        seen = {s: int(u) for s, u in zip(counts["s"], counts["under"])}
        fresh = np.concatenate([np.empty(0), *(np.asarray(x, float) for x in counts["near"])])
        for r in state.itertuples(index=False):
            search = trends.Search(r.k, 0, r.grain, r.low, r.high, r.under_low, r.under_high)
            search.narrow(seen)
            near = np.concatenate([np.asarray(r.near, float), fresh])
            near = np.sort(near[(near >= search.low - search.step()) & (near <= search.high + search.step())])
            slope = search.found(near) if search.done() else None
            out.append((r[0], r[1], r.k, search.low, search.high, search.under_low, search.under_high, r.grain, near.tolist(), [] if slope is not None else search.probes(near), slope))
        return pd.DataFrame(out, columns=state_of.replace(",", "").split()[::2])

    begun = scored.drop("n").join(base, "_k")
    state = written(begun.select("_k", "pairs", "variance", "xs", "ys").withColumnRenamed("_k", "_1").mapInPandas(searches, state_of), "trend-search")
    finished = None
    for _ in range(MOST_PASSES):
        asked = state.where("slope is null").groupBy("_k").agg(F.array_distinct(F.flatten(F.collect_list("asked"))).alias("asked")).join(base.drop("asked"), "_k")
        counts = _under(placed.join(asked.select("_k"), "_k", "left_semi"), asked)
        moved = written(state.where("slope is null").groupBy("_k").cogroup(counts.withColumnRenamed("_k", "_key").groupBy("_key")).applyInPandas(advance, state_of), "trend-search")
        done = moved.where("slope is not null").select("_k", "_rank", "slope")
        finished = done if finished is None else finished.unionByName(done)
        state = moved
        if state.where("slope is null").isEmpty():
            break
    else:
        raise ArithmeticError(f"no slope was found within {MOST_PASSES} passes")
    slopes = finished.groupBy("_k").agg(F.transform(F.array_sort(F.collect_list(F.struct("_rank", "slope"))), lambda s: s["slope"]).alias("slopes"))
    return scored.drop("slopes").join(slopes, "_k", "left").select("_k", *_FOUND)


def pair_counts(df: DataFrame, order: str, value: str, by: list[str], sloped: bool = True) -> DataFrame:
    """Per series (by): n, pairs with different ``order``, score, variance, tau_b and, if ``sloped``, four slopes: the two
    middle ones and the ends of their 95 % interval (an array, null without pairs).

    Nothing is joined with itself: a series of up to ``BLOCK`` points is counted by one task, longer ones by blocks.
    Non-finite points are dropped, points of one ``order`` make no pair, equal rows count each, a null key is a series;
    names of columns are free, and an empty table has no series.
    """
    key = F.to_json(F.struct(*(F.col(c).alias(f"b{i}") for i, c in enumerate(by))), {"ignoreNullFields": "false"}) if by else F.lit("")
    rows = finite(df.select(key.alias("_k"), F.struct(*(F.col(c).alias(f"b{i}") for i, c in enumerate(by)), F.lit(0).alias("_")).alias("_by"), F.col(order).cast("double").alias("_x"), F.col(value).cast("double").alias("_y")), "_x", "_y")
    rows = written(rows, "trend-rows")
    sizes = rows.groupBy("_k").agg(F.count("*").alias("_size"), F.first("_by").alias("_by"))
    keys = written(sizes, "trend-keys")
    rows, longer = rows.drop("_by"), keys.where(F.col("_size") > BLOCK)
    if longer.isEmpty():
        found = _short(rows, sloped)
    else:
        long_keys = longer.select("_k")
        found = _short(rows.join(long_keys, "_k", "left_anti"), sloped).unionByName(_long(rows.join(long_keys, "_k", "left_semi"), sloped))
    return found.join(keys, "_k").select(*(F.col(f"_by.b{i}").alias(c) for i, c in enumerate(by)), *(F.col(c).alias(f"_{c}") for c in _FOUND))


def _middle(df: DataFrame, order: str, value: str, by: list[str]) -> DataFrame:
    """Medians _mx and _my of each series, its keys as _b0, _b1, ..."""
    rows = finite(df.select(*(F.col(c).alias(f"_b{i}") for i, c in enumerate(by)), F.col(order).alias("_x"), F.col(value).alias("_y")), "_x", "_y")
    keys = [f"_b{i}" for i in range(len(by))]
    x, y = quantiles(rows, keys, "_x", [0.5], "_qx"), quantiles(rows, keys, "_y", [0.5], "_qy").withColumnsRenamed({k: f"{k}_y" for k in keys})
    return x.join(y, null_safe([(k, f"{k}_y") for k in keys])).select(*keys, F.col("_qx")[0].alias("_mx"), F.col("_qy")[0].alias("_my"))


def sloped(df: DataFrame, order: str, value: str, by: list[str]) -> DataFrame:
    """``pair_counts`` with _slope (the median), _intercept, _low and _high."""
    found = pair_counts(df, order, value, by).join(_middle(df, order, value, by), null_safe([(c, f"_b{i}") for i, c in enumerate(by)]))
    s = F.col("_slopes")
    slope = F.when(F.col("_pairs") > 0, s[0] + (s[1] - s[0]) / 2)
    found = found.withColumn("_slope", slope).withColumns({"_low": F.when(F.col("_pairs") > 0, s[2]), "_high": F.when(F.col("_pairs") > 0, s[3])})
    return found.withColumn("_intercept", F.col("_my") - F.col("_slope") * F.col("_mx"))


def theil_sen(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """Median of pairwise slopes, and the intercept med(y) - slope med(x); a series without a pair has none."""
    found = sloped(df, x, y, list(by)).where("_pairs > 0")
    return found.select(*by, *(F.col(f"_{c}").alias(c) for c in ("n", "slope", "intercept")))


def kendall_z() -> Column:
    """z of the score with its correction for continuity, from _score and _variance."""
    return ratio(F.col("_score") - F.signum("_score"), F.sqrt("_variance"), 0.0)


def mann_kendall(df: DataFrame, order: str, value: str, by: list[str]) -> DataFrame:
    """S (score) over the rows' order, its tie-corrected variance, the continuity-corrected z, and tau-b; of series with a pair."""
    found = pair_counts(df, order, value, list(by), sloped=False).where("_pairs > 0").withColumn("_z", kendall_z())
    return found.select(*by, *(F.col(f"_{c}").alias(c) for c in ("n", "score", "variance", "z", "tau_b")))


def growth(df: DataFrame, time: str, density: str, by: list[str]) -> DataFrame:
    """Peak, its time, the greatest log slope with its doubling time, trapezoid area, and whether the curve crashes after the peak."""
    rows = finite(df, time, density)
    order = Window.partitionBy(*by).orderBy(time)
    dt, previous = F.col(time) - F.lag(time).over(order), F.lag(density).over(order)
    log_slope = F.when((F.col(density) > 0) & (previous > 0) & (dt > 0), (F.ln(density) - F.ln(previous)) / dt)
    steps = rows.withColumn("_area", F.coalesce(dt * (F.col(density) + previous) / 2, F.lit(0.0))).withColumn("_slope", log_slope).withColumn("_at", F.row_number().over(order))
    s = steps.groupBy(*by).agg(
        F.count("*").alias("n"), F.max(density).alias("peak"), F.min_by(F.col(time), F.struct(-F.col(density), F.col(time))).alias("peak_time"), F.min_by("_at", F.struct(-F.col(density), F.col(time))).alias("_peak_at"),
        F.max("_slope").alias("growth_rate"), F.sum("_area").alias("auc"), F.max_by(density, time).alias("final"),
    )
    crash = (F.col("n") - F.col("_peak_at") > 2) & (F.col("final") < 0.6 * F.col("peak"))
    return s.select(*by, "n", "peak", "peak_time", "growth_rate", ratio(F.lit(float(np.log(2))), F.col("growth_rate")).alias("doubling_time"), "auc", "final", crash.alias("crashes"))


def akaike(df: DataFrame, aicc: str, by: list[str]) -> DataFrame:
    """Differences to the best model and Akaike weights of a data set's models."""
    w = Window.partitionBy(*by)
    delta = F.col(aicc) - F.min(aicc).over(w)
    rows = df.withColumn("delta", delta)
    return rows.withColumn("weight", F.exp(-F.col("delta") / 2) / F.sum(F.exp(-F.col("delta") / 2)).over(w))
