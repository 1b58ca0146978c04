"""Group comparisons: descriptives, effect sizes, assumption checks and test statistics.

Input is a long table of one measurement a row.  Non-finite values are dropped first.  Everything is
reduced to one row a group (or a distinct value) before groups are compared, so pairs of groups are
joined on compact statistics and never on measurements.  ``by`` names the columns of a data set.

Defined cases: a null key is a data set of its own, a null label a group of its own without pairs; keys may have any
name (a result of that name gets an underscore); equal rows count each, ties share their rank; an empty table has no
rows, or one of nulls and zero counts where there is no key.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skerry.functions import exact, special
from skerry.functions.columns import finite, is_finite, meet, own_names, ratio, running_sum
from skerry.functions.quantiles import quantiles


@own_names
def summaries(df: DataFrame, group: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """One row a group: n, mean, variance (n - 1; 0.0 for one value)."""
    rows = finite(df, value)
    return rows.groupBy(*by, F.col(group).alias("group_label")).agg(
        F.count("*").alias("n"), F.avg(value).alias("mean"), F.coalesce(F.when(F.count("*") > 1, F.var_samp(value)), F.lit(0.0)).alias("variance")
    )


@own_names
def describe(df: DataFrame, group: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """n, mean, sd, se, median, quartiles (linear), minimum and maximum of each group."""
    rows = finite(df, value).select(*by, F.col(group).alias("group_label"), F.col(value).cast("double").alias("_v"))
    keys = [*by, "group_label"]
    found = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg("_v").alias("mean"), F.coalesce(F.when(F.count("*") > 1, F.stddev_samp("_v")), F.lit(0.0)).alias("sd"), F.min("_v").alias("minimum"), F.max("_v").alias("maximum")
    )
    found = meet(found, quantiles(rows, keys, "_v", (0.25, 0.5, 0.75), "_q"), keys)
    return found.select(*keys, "n", "mean", "sd", (F.col("sd") / F.sqrt("n")).alias("se"), F.col("_q")[1].alias("median"), F.col("_q")[0].alias("q1"), F.col("_q")[2].alias("q3"), "minimum", "maximum")


def pairs(stats: DataFrame, by: Sequence[str] = (), label: str = "group_label") -> DataFrame:
    """All pairs a < b of a data set's rows of statistics, as columns ``a_...`` and ``b_...``."""
    others = [c for c in stats.columns if c not in by]
    a = stats.select(*by, *(F.col(c).alias(f"a_{c}") for c in others))
    b = stats.select(*(F.col(c).alias(f"_{c}") for c in by), *(F.col(c).alias(f"b_{c}") for c in others))
    match = F.col(f"a_{label}") < F.col(f"b_{label}")
    for c in by:
        match = match & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return a.join(b, match).drop(*(f"_{c}" for c in by))


@own_names
def mid_ranks(df: DataFrame, group: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Each group's size and sum of mid-ranks, and the data set's size and tie term (sum of t^3 - t)."""
    rows = finite(df, value).select(*by, F.col(group).alias("group_label"), F.col(value).cast("double").alias("v"))
    cells = rows.groupBy(*by, "v", "group_label").agg(F.count("*").alias("c"))
    keys = [*by]
    values = running_sum(cells.groupBy(*keys, "v").agg(F.sum("c").alias("t")), keys, ["v"], "t", "upto")
    ranked = meet(cells, values, [*keys, "v"]).withColumn("rank", F.col("upto") - F.col("t") + (F.col("t") + 1) / 2.0)
    groups = ranked.groupBy(*keys, "group_label").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("rank")).alias("rank_sum"))
    ties = values.groupBy(*keys).agg(F.sum("t").alias("total"), F.sum((F.pow("t", F.lit(3.0)) - F.col("t"))).alias("tie_term"))
    return meet(groups, ties, keys)


@own_names
def effects(df: DataFrame, group: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """For each pair of groups: Cohen's d, Hedges' g, Glass's delta against b, the mean difference."""
    p = pairs(summaries(df, group, value, by), by)
    freedom = F.col("a_n") + F.col("b_n") - 2
    pooled = F.sqrt(ratio((F.col("a_n") - 1) * F.col("a_variance") + (F.col("b_n") - 1) * F.col("b_variance"), freedom, 0.0))
    difference = F.col("a_mean") - F.col("b_mean")
    d = ratio(difference, pooled, 0.0)
    g = F.when(freedom > 1, d * (1 - 3.0 / (4 * freedom - 1))).otherwise(d)
    return p.select(*by, "a_group_label", "b_group_label", difference.alias("difference"), d.alias("cohens_d"), g.alias("hedges_g"), ratio(difference, F.sqrt("b_variance"), 0.0).alias("glass_delta"))


def pairwise_ranks(df: DataFrame, group: str, value: str, a: str, b: str) -> DataFrame:
    """Mann-Whitney U of two groups, the common-language effect P(A > B) + P(=)/2, and the rank-biserial correlation."""
    two = mid_ranks(df.where(F.col(group).isin(a, b)), group, value)
    wide = two.groupBy("total", "tie_term").agg(
        *(F.max(F.when(F.col("group_label") == k, F.col(c))).alias(f"{c}_{s}") for k, s in ((a, "a"), (b, "b")) for c in ("n", "rank_sum"))
    )
    u = F.col("rank_sum_a") - F.col("n_a") * (F.col("n_a") + 1) / 2.0
    cles = u / (F.col("n_a") * F.col("n_b"))
    return wide.select(F.col("n_a"), F.col("n_b"), u.alias("u"), cles.alias("cles"), (2 * cles - 1).alias("rank_biserial"), "tie_term")


@own_names
def anova(df: DataFrame, group: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """One-way F with its degrees of freedom, and eta squared (share of the total sum of squares)."""
    s = summaries(df, group, value, by)
    total = s.groupBy(*by).agg(
        F.count("*").alias("_k"), F.sum("n").alias("_total"), F.sum(F.col("n") * F.col("mean")).alias("_sum"),
        F.sum(F.col("n") * F.col("mean") * F.col("mean")).alias("_sum2"), F.sum((F.col("n") - 1) * F.col("variance")).alias("_within"),
    )
    between = F.col("_sum2") - F.col("_sum") * F.col("_sum") / F.col("_total")
    f = ratio(between / (F.col("_k") - 1), F.col("_within") / (F.col("_total") - F.col("_k")))
    return total.where("_k > 1 and _total > _k").select(*by, (F.col("_k") - 1).alias("df_between"), (F.col("_total") - F.col("_k")).alias("df_within"), f.alias("f"), ratio(between, between + F.col("_within"), 0.0).alias("eta_squared"))


@own_names
def t_tests(df: DataFrame, group: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Pooled and Welch t of each pair of groups with their degrees of freedom."""
    p = pairs(summaries(df, group, value, by), by).where("a_n > 1 and b_n > 1")
    n, m = F.col("a_n"), F.col("b_n")
    difference = F.col("a_mean") - F.col("b_mean")
    pooled = ((n - 1) * F.col("a_variance") + (m - 1) * F.col("b_variance")) / (n + m - 2)
    x, y = F.col("a_variance") / n, F.col("b_variance") / m
    return p.select(
        *by, "a_group_label", "b_group_label", ratio(difference, F.sqrt(pooled * (1 / n + 1 / m))).alias("t"), (n + m - 2).alias("df"),
        ratio(difference, F.sqrt(x + y)).alias("welch_t"), ratio((x + y) * (x + y), x * x / (n - 1) + y * y / (m - 1)).alias("welch_df"),
    )


@own_names
def paired_t(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """t of the differences of two columns of one row; rows with a non-finite member are dropped whole."""
    d = finite(df, x, y).withColumn("_d", F.col(x) - F.col(y))
    s = d.groupBy(*by).agg(F.count("*").alias("n"), F.avg("_d").alias("mean"), F.stddev_samp("_d").alias("sd"))
    return s.where("n > 1").select(*by, "n", (F.col("n") - 1).alias("df"), ratio(F.col("mean"), F.col("sd") / F.sqrt("n")).alias("t"), ratio(F.col("mean"), F.col("sd"), 0.0).alias("cohens_d"))


def signed_ranks(df: DataFrame, x: str, y: str) -> DataFrame:
    """Wilcoxon's signed-rank sums of x - y; zero differences are dropped, ties share their rank."""
    d = finite(df, x, y).select((F.col(x) - F.col(y)).alias("d")).where("d <> 0")
    cells = d.groupBy(F.abs("d").alias("v")).agg(F.count("*").alias("t"), F.count_if(F.col("d") > 0).alias("plus"))
    ranked = running_sum(cells, [], ["v"], "t", "upto").withColumn("rank", F.col("upto") - F.col("t") + (F.col("t") + 1) / 2.0)
    return ranked.agg(F.sum("t").alias("n"), F.sum(F.col("plus") * F.col("rank")).alias("w_plus"), F.sum((F.col("t") - F.col("plus")) * F.col("rank")).alias("w_minus"), F.sum(F.pow("t", F.lit(3.0)) - F.col("t")).alias("tie_term"))


@own_names
def kruskal(df: DataFrame, group: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Tie-corrected H, its degrees of freedom, and epsilon squared (H - k + 1) / (n - k)."""
    r = mid_ranks(df, group, value, by)
    s = r.groupBy(*by, "total", "tie_term").agg(F.count("*").alias("k"), F.sum(F.col("rank_sum") * F.col("rank_sum") / F.col("n")).alias("squares"))
    n = F.col("total").cast("double")
    h = ratio(12 / (n * (n + 1)) * F.col("squares") - 3 * (n + 1), 1 - F.col("tie_term") / (n * n * n - n))
    return s.where("k > 1").select(*by, (F.col("k") - 1).alias("df"), h.alias("h"), ratio(h - F.col("k") + 1, n - F.col("k")).alias("epsilon_squared"))


@own_names
def brown_forsythe(df: DataFrame, group: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """One-way F of the distances to the group medians; a null label is a group of its own."""
    rows = finite(df, value).select(*by, F.col(group).alias("_g"), F.col(value).cast("double").alias("_v"))
    keys = [*by, "_g"]
    away = meet(rows, quantiles(rows, keys, "_v", [0.5], "_median"), keys).withColumn("_away", F.abs(F.col("_v") - F.col("_median")[0]))
    return anova(away, "_g", "_away", by).select(*by, "df_between", "df_within", F.col("f").alias("levene"))


def contingency(df: DataFrame, row: str, column: str) -> DataFrame:
    """Cells with observed and expected counts."""
    cells = df.where(F.col(row).isNotNull() & F.col(column).isNotNull()).groupBy(F.col(row).alias("row_label"), F.col(column).alias("col_label")).agg(F.count("*").alias("observed"))
    rows = cells.groupBy("row_label").agg(F.sum("observed").alias("r"))
    columns = cells.groupBy("col_label").agg(F.sum("observed").alias("c"))
    total = cells.agg(F.sum("observed").alias("total"))
    grid = rows.crossJoin(columns).crossJoin(total)  # labels of two category columns, one row of total
    return grid.join(cells, ["row_label", "col_label"], "left").select("row_label", "col_label", F.coalesce("observed", F.lit(0)).alias("observed"), (F.col("r") * F.col("c") / F.col("total")).alias("expected"))


def chi_square(df: DataFrame, row: str, column: str) -> DataFrame:
    """Chi-square, its degrees of freedom, the smallest expected count, and Cramer's V with Bergsma's correction."""
    c = contingency(df, row, column)
    s = c.agg(F.sum((F.col("observed") - F.col("expected")) ** 2 / F.col("expected")).alias("chi2"), F.sum("observed").alias("n"), F.count_distinct("row_label").alias("r"), F.count_distinct("col_label").alias("k"), F.min("expected").alias("least_expected"))
    n = F.col("n").cast("double")
    phi = F.greatest(F.lit(0.0), F.col("chi2") / n - (F.col("k") - 1) * (F.col("r") - 1) / (n - 1))
    rows, columns = F.col("r") - (F.col("r") - 1) ** 2 / (n - 1), F.col("k") - (F.col("k") - 1) ** 2 / (n - 1)
    v = F.sqrt(ratio(phi, F.least(rows, columns) - 1, 0.0))
    return s.select("n", "chi2", ((F.col("r") - 1) * (F.col("k") - 1)).alias("df"), "least_expected", v.alias("cramers_v"))


def interpret(value: Column, kind: str = "hedges_g", low: Column | None = None, high: Column | None = None) -> Column:
    """The size of an effect in words, with a reservation where its interval holds 0; what isn't finite is not estimable."""
    # Upper limits of negligible, small and moderate.
    limits = {
        "hedges_g": (0.2, 0.5, 0.8), "cohens_d": (0.2, 0.5, 0.8), "eta_squared": (0.01, 0.06, 0.14),
        "epsilon_squared": (0.01, 0.08, 0.26), "cramers_v": (0.1, 0.3, 0.5), "rank_biserial": (0.1, 0.3, 0.5),
    }[kind]
    size = F.abs(value)
    words = F.when(size < limits[0], "negligible").when(size < limits[1], "small").when(size < limits[2], "moderate").otherwise("large")
    if low is not None and high is not None:
        open_ = F.coalesce(is_finite(low) & is_finite(high) & (low * high <= 0), F.lit(False))
        words = F.when(open_, F.concat(words, F.lit(" here, but the interval holds 0, so the direction is open"))).otherwise(words)
    return F.when(is_finite(value), words).otherwise("not estimable")


def with_p(df: DataFrame, kind: str, *arguments: str, to: str = "p_value") -> DataFrame:
    """A p-value column from columns of statistics; one row a test, computed in Arrow batches."""
    tails = {"t": special.t_two_sided, "f": special.f_tail, "chi2": special.chi2_tail, "normal": special.normal_two_sided, "mann_whitney": exact.mann_whitney_p, "wilcoxon": exact.wilcoxon_p, "fisher": exact.fisher_p}
    tail = tails[kind]

    @F.pandas_udf("double")
    def run(*columns: pd.Series) -> pd.Series:
        return pd.Series([np.nan if any(pd.isna(v) for v in row) else float(tail(*((int(v) if kind in ("fisher",) else v) for v in row))) for row in zip(*columns)], dtype=float)

    return df.withColumn(to, run(*(F.col(a).cast("double") for a in arguments)))


def holm(df: DataFrame, p: str, by: Sequence[str] = (), tie: Sequence[str] = (), to: str = "p_holm") -> DataFrame:
    """Holm's step-down adjustment within ``by``; the rows of one ``by`` value are the tests of one data set."""
    m = F.count("*").over(Window.partitionBy(*by))
    order = Window.partitionBy(*by).orderBy(F.col(p), *tie)
    raised = (m - F.row_number().over(order) + 1) * F.col(p)
    return df.withColumn("_raised", raised).withColumn(to, F.least(F.lit(1.0), F.max("_raised").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))).drop("_raised")


def benjamini_hochberg(df: DataFrame, p: str, by: Sequence[str] = (), tie: Sequence[str] = (), to: str = "p_bh") -> DataFrame:
    """Step-up false-discovery adjustment within ``by``."""
    m = F.count("*").over(Window.partitionBy(*by))
    rows = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(F.col(p), *tie)))
    rows = rows.withColumn("_raised", F.col(p) * m / F.col("_rn"))
    back = Window.partitionBy(*by).orderBy(F.desc("_rn")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn(to, F.least(F.lit(1.0), F.min("_raised").over(back))).drop("_rn", "_raised")
