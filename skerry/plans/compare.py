"""Comparison of groups with the test that the data's properties call for, one row a data set."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.functions import exact
from skerry.functions.columns import finite, meet, own_names
from skerry.functions.shared import written
from skerry.operators import diversity, groups, series
from skerry.operators.robust import sentence

#: Up to this many values a data set's permutation test is one task; with more, blocks of values are shuffled in tasks of their own.
MAX_PERMUTED = 400
SHUFFLES, BLOCK_VALUES, SEED = 9_999, 4096, 20260901
FLOOR = 3


def normality(df: DataFrame, group: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Shapiro-Wilk of each group of 3 to 5 000 values; others have null."""
    rows = finite(df, value).select(*by, F.col(group).alias("group_label"), F.col(value).cast("double").alias("v"))
    keys = [*by, "group_label"]
    for c in keys:
        rows = rows.where(F.col(c).isNotNull())
    # rows of large groups stay where they are; there is at most one large group for 5 000 rows
    large = rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 5000").select(*keys)
    kinds = dict(rows.dtypes)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        judged = [(*key, *exact.shapiro(pdf["v"].to_numpy()))] if len(pdf) >= 3 else []
        return pd.DataFrame(judged, columns=[*keys, "w", "p_normal"])

    return rows.join(F.broadcast(large), keys, "left_anti").groupBy(*keys).applyInPandas(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "w double", "p_normal double"]))


def _permutations(df: DataFrame, group: str, value: str, by: Sequence[str]) -> DataFrame:
    """Permutation p of two-group data sets of at most MAX_PERMUTED values."""
    rows = finite(df, value).select(*by, F.col(group).cast("string").alias("g"), F.col(value).cast("double").alias("v"))
    kinds = dict(rows.dtypes)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [p["v"].to_numpy() for _, p in pdf.groupby("g", sort=True)]
        return pd.DataFrame([(*key, exact.permutation_p(*parts)[0])], columns=[*by, "p_permutation"])

    return rows.groupBy(*by).applyInPandas(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in by), "p_permutation double"]))


def _dealt_permutations(df: DataFrame, group: str, value: str, by: Sequence[str]) -> DataFrame:
    """Permutation p of two-group data sets of any size: the same test, from SHUFFLES uniform splits.

    Values are dealt into blocks by hash.  How many of a split's first group come from each block is one hypergeometric
    draw, and which ones is a shuffle within the block, so that only sums leave a block.
    """
    rows = finite(df, value).select(*by, F.col(group).cast("string").alias("_g"), F.col(value).cast("double").alias("_v"))
    keys = ", ".join(f"`{k}` {t}" for k, t in rows.dtypes if k in by)
    one = rows.groupBy(*by, "_g").agg(F.count("*").alias("_n"), F.sum("_v").alias("_s"))
    panel = one.groupBy(*by).agg(
        F.min_by("_n", "_g").alias("_n_a"), F.max_by("_n", "_g").alias("_n_b"), F.min_by("_s", "_g").alias("_s_a"), F.max_by("_s", "_g").alias("_s_b"), F.ceil(F.sum("_n") / BLOCK_VALUES).alias("_blocks")
    ).persist()
    values = rows.groupBy(*by, "_v").agg(F.count("*").alias("_times")).join(panel.select(*by, "_blocks"), list(by)).withColumn("_block", F.pmod(F.xxhash64("_v"), F.col("_blocks"))).drop("_blocks")
    sizes = values.groupBy(*by, "_block").agg(F.sum("_times").alias("_size")).join(panel.select(*by, "_n_a"), list(by))
    shuffles, seed = SHUFFLES, SEED

    def deal(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_block")
        taken = np.random.default_rng(seed).multivariate_hypergeometric(pdf["_size"].to_numpy(), int(pdf["_n_a"].iloc[0]), size=shuffles, method="marginals")
        return pd.DataFrame([(*key, b, taken[:, i].astype("<i8").tobytes()) for i, b in enumerate(pdf["_block"])], columns=[*by, "_block", "_taken"])

    def shuffle(key: tuple, held: pd.DataFrame, taken: pd.DataFrame) -> pd.DataFrame:
        held, rng = held.sort_values("_v"), np.random.default_rng([seed, int(key[-1])])
        v, times = held["_v"].to_numpy(), held["_times"].to_numpy()
        k = np.frombuffer(taken["_taken"].iloc[0], "<i8")
        if times.sum() > 4 * BLOCK_VALUES:  # many equal values: how often each is taken
            sums = [rng.multivariate_hypergeometric(times, int(n), method="marginals") @ v for n in k]
        else:
            pool = np.repeat(v, times)
            sums = [rng.permutation(pool)[:n].sum() for n in k]
        found = pd.DataFrame({"_replicate": np.arange(shuffles), "_part": np.asarray(sums, float)})
        return found.assign(**dict(zip(by, key[:-1])))[[*by, "_replicate", "_part"]]

    dealt = sizes.groupBy(*by).applyInPandas(deal, f"{keys}, _block long, _taken binary")
    parts = values.groupBy(*by, "_block").cogroup(dealt.groupBy(*by, "_block")).applyInPandas(shuffle, f"{keys}, _replicate long, _part double")
    null = parts.groupBy(*by, "_replicate").agg(F.sum("_part").alias("_s")).join(panel, list(by))
    difference = F.col("_s") / F.col("_n_a") - (F.col("_s_a") + F.col("_s_b") - F.col("_s")) / F.col("_n_b")
    observed = F.col("_s_a") / F.col("_n_a") - F.col("_s_b") / F.col("_n_b")
    slack = 1e-12 * F.greatest(F.lit(1.0), F.abs(observed))
    tails = null.groupBy(*by).agg(F.count_if(difference <= observed + slack).alias("_low"), F.count_if(difference >= observed - slack).alias("_high"))
    return tails.select(*by, F.least(F.lit(1.0), 2 * (F.least("_low", "_high") + 1) / F.lit(shuffles + 1.0)).alias("p_permutation"))


def _tested(route: str, df: DataFrame, s: DataFrame, group: str, value: str, keys: list[str]) -> DataFrame:
    """(keys, statistic, p_value) of data sets that all take one route; ``s`` are their summaries."""
    named = lambda table, statistic: table.select(*keys, F.col(statistic).alias("statistic"), "p_value")
    if route == "ttest_ind":
        return named(groups.with_p(groups.t_tests(df, group, value, keys), "t", "t", "df"), "t")
    if route == "welch":
        return named(groups.with_p(groups.t_tests(df, group, value, keys), "t", "welch_t", "welch_df"), "welch_t")
    if route == "anova":
        return named(groups.with_p(groups.anova(df, group, value, keys), "f", "f", "df_between", "df_within"), "f")
    if route == "kruskal":
        return named(groups.with_p(groups.kruskal(df, group, value, keys), "chi2", "h", "df"), "h")
    if route == "alexandergovern":
        # one row a group of a data set
        govern = s.groupBy(*keys).agg(F.collect_list("n").alias("n"), F.collect_list("mean").alias("m"), F.collect_list("variance").alias("v"))

        @F.pandas_udf("struct<statistic:double,p_value:double>")
        def alexander(n: pd.Series, m: pd.Series, v: pd.Series) -> pd.DataFrame:
            return pd.DataFrame([exact.alexander_govern(np.asarray(a, float), np.asarray(b), np.asarray(c)) for a, b, c in zip(n, m, v)], columns=["statistic", "p_value"])

        return govern.withColumn("x", alexander("n", "m", "v")).select(*keys, "x.statistic", "x.p_value")
    total = s.groupBy(*keys).agg(F.sum("n").alias("_total"))
    at_once, dealt = (df.join(total.where(size).select(*keys), keys, "left_semi") for size in (F.col("_total") <= MAX_PERMUTED, F.col("_total") > MAX_PERMUTED))
    p = _permutations(at_once, group, value, keys)
    if not total.where(F.col("_total") > MAX_PERMUTED).isEmpty():
        p = p.unionByName(_dealt_permutations(dealt, group, value, keys))
    difference = groups.effects(df, group, value, keys).select(*keys, F.col("difference").alias("statistic"))
    return p.withColumnRenamed("p_permutation", "p_value").join(difference, keys).select(*keys, "statistic", "p_value")


def compare_groups(df: DataFrame, group: str, value: str, by: Sequence[str] = (), alpha: float = 0.05, prefer_robust: bool = False) -> DataFrame:
    """Per data set: groups, least size, route, statistic, p, effect sizes and what they say; fewer than 2 groups or 3 values are refused with a reason.

    Two groups: permutation if robust is preferred, a group has under 10 values or isn't normal; Welch if the
    variances differ; else the pooled t.  More groups: Kruskal-Wallis, Alexander-Govern, one-way F in the same cases.
    Normality is not tested in groups of more than 5 000 values, which count as normal, as in the engine that this follows.
    The route is chosen first, and each test runs on the data sets that take it.  hedges_g and cles (the chance that a
    value of the first group, by name, is the greater one) are of two groups, eta_squared of any number.

    Null keys are data sets, columns may have any names, an empty table has no data sets (refused ones have null results).
    """
    kinds = dict(df.dtypes)
    # keys as text under names of their own, so that a null key is a data set too and no name clashes
    keys = [f"_by{i}" for i in range(len(by))] or ["_all"]
    named = [F.to_json(F.struct(F.col(c).alias("v"))).alias(k) for k, c in zip(keys, by)] or [F.lit("").alias("_all")]
    rows = written(finite(df.select(*named, F.col(group).alias("_group"), F.col(value).cast("double").alias("_value")), "_value"), "compared")
    s = written(groups.summaries(rows, "_group", "_value", keys), "summaries")
    panel = s.groupBy(*keys).agg(F.count("*").alias("k"), F.min("n").alias("least_n"), F.min("variance").alias("least_variance"))
    normal = normality(rows, "_group", "_value", keys).groupBy(*keys).agg(F.min(F.when(~F.isnan("p_normal"), F.col("p_normal"))).alias("p_normal"))
    levene = groups.with_p(groups.brown_forsythe(rows, "_group", "_value", keys), "f", "levene", "df_between", "df_within", to="p_variance").select(*keys, "p_variance")
    panel = panel.join(normal, keys, "left").join(levene, keys, "left")
    doubtful = F.lit(prefer_robust) | (F.col("least_n") < 10) | F.coalesce(F.col("p_normal") <= alpha, F.lit(False))
    unequal = F.coalesce(F.col("p_variance") <= alpha, F.lit(False))
    two = F.col("k") == 2
    route = F.when(F.col("k") < 2, None).when(F.col("least_n") < FLOOR, None).when(two & doubtful, "permutation").when(two & unequal, "welch").when(two, "ttest_ind").when(doubtful, "kruskal").when(unequal & (F.col("least_variance") > 0), "alexandergovern").otherwise("anova")
    panel = panel.withColumn("route", route).withColumn("reason", F.when(F.col("k") < 2, "fewer than 2 groups").when(F.col("least_n") < FLOOR, f"a group has fewer than {FLOOR} values"))
    panel = written(panel, "panel")
    routes = sorted(r["route"] for r in panel.where("route is not null").select("route").distinct().collect())  # six at most
    alone = len(routes) == 1 and panel.where("route is null").isEmpty()
    found = None
    for name in routes:
        mine = panel.where(F.col("route") == name).select(*keys)
        pick = lambda table, mine=mine: table if alone else table.join(mine, keys, "left_semi")
        test = _tested(name, pick(rows), pick(s), "_group", "_value", keys)
        found = test if found is None else found.unionByName(test)
    if found is None:
        found = panel.select(*keys, F.lit(None).cast("double").alias("statistic"), F.lit(None).cast("double").alias("p_value")).where("false")
    pairs = panel.where("k = 2 and route is not null").select(*keys)
    effect = groups.anova(rows, "_group", "_value", keys).select(*keys, "eta_squared")
    if pairs.isEmpty():
        panel = panel.withColumns({"hedges_g": F.lit(None).cast("double"), "cles": F.lit(None).cast("double")})
    else:
        two_groups = rows.join(pairs, keys, "left_semi")
        g = groups.effects(two_groups, "_group", "_value", keys).select(*keys, "hedges_g")
        ranks = groups.mid_ranks(two_groups, "_group", "_value", keys).groupBy(*keys).agg(F.min_by(F.struct("n", "rank_sum"), F.col("group_label").cast("string")).alias("_a"), F.sum("n").alias("_total"))
        n = F.col("_a.n").cast("double")
        cles = (F.col("_a.rank_sum") - n * (n + 1) / 2) / (n * (F.col("_total") - n))
        panel = panel.join(g, keys, "left").join(ranks.select(*keys, cles.alias("cles")), keys, "left")
    whole = panel.join(found, keys, "left").join(effect, keys, "left")
    size = F.when(F.col("hedges_g").isNotNull(), groups.interpret(F.col("hedges_g"), "hedges_g")).otherwise(groups.interpret(F.col("eta_squared"), "eta_squared"))
    said = F.when(F.col("p_value").isNotNull() & ~F.isnan("p_value"), sentence(F.col("p_value"), F.coalesce("hedges_g", "eta_squared"), size, alpha))
    back = [F.from_json(F.col(k), f"v {kinds[c]}")["v"].alias(c) for k, c in zip(keys, by)]
    results = [*(F.col(c) for c in ("k", "least_n", "p_normal", "p_variance", "route", "statistic", "p_value", "eta_squared", "hedges_g", "cles")), said.alias("sentence"), F.col("route").isNull().alias("refused"), F.col("reason")]
    names = ("n_groups" if "k" in by else "k", "least_n", "p_normal", "p_variance", "route", "statistic", "p_value", "eta_squared", "hedges_g", "cles", "sentence", "refused", "reason")
    return whole.select(*back, *(c.alias(f"{n}_" if n in by else n) for c, n in zip(results, names)))


@own_names
def post_hoc(df: DataFrame, group: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Welch t of all pairs with p, Holm's correction within the data set, and Hedges' g."""
    pair = [*by, "a_group_label", "b_group_label"]
    tests = groups.with_p(groups.t_tests(df, group, value, by), "t", "welch_t", "welch_df")
    tests = groups.holm(tests, "p_value", by, pair[len(by) :])
    return meet(tests, groups.effects(df, group, value, by).select(*pair, "hedges_g"), pair).select(*pair, "welch_t", "welch_df", "p_value", "p_holm", "hedges_g")


def correlate(df: DataFrame, x: str, y: str, alpha: float = 0.05) -> DataFrame:
    """One row: the coefficient that the data call for, its p, r squared, and the least-squares line.

    Pearson from 15 pairs on if neither column departs from a normal distribution, else Spearman; under 4 pairs are
    refused.  Rows with a non-finite member are dropped whole; a constant column has no coefficient.
    """
    rows = finite(df.select(F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")), "_x", "_y")
    long = rows.select(F.explode(F.array(*(F.struct(F.lit(c).alias("side"), F.col(c).alias("v")) for c in ("_x", "_y")))).alias("s")).select("s.*")
    normal = normality(long, "side", "v").agg(F.min("p_normal").alias("p_normal"), F.count("*").alias("judged"))
    one = series.line(rows, "_x", "_y").join(F.broadcast(series.spearman(rows, "_x", "_y").drop("n"))).join(F.broadcast(normal))  # one row each
    pearson = (F.col("n") >= 15) & (F.col("judged") == 2) & (F.col("p_normal") > alpha)
    one = one.withColumn("route", F.when(F.col("n") < 4, None).when(pearson, "pearson").otherwise("spearman"))
    one = one.withColumn("coefficient", F.when(F.col("route") == "pearson", F.col("pearson")).when(F.col("route") == "spearman", F.col("spearman")))
    rest = 1 - F.col("coefficient") * F.col("coefficient")
    one = one.withColumn("_t", F.when(rest > 0, F.col("coefficient") * F.sqrt((F.col("n") - 2) / rest)).when(rest <= 0, F.signum("coefficient") * 1e9)).withColumn("_df", F.col("n") - 2)
    tested = groups.with_p(one, "t", "_t", "_df")
    return tested.select("n", "route", "coefficient", "p_value", (F.col("coefficient") ** 2).alias("r_squared"), "slope", "intercept", F.col("route").isNull().alias("refused"))


def contingency_test(df: DataFrame, row: str, column: str) -> DataFrame:
    """One row: Fisher's exact test of a 2 x 2 table with an expected count under 5, else chi-square (with Yates' correction at 2 x 2); Cramer's V."""
    cells = groups.contingency(df, row, column).persist()
    chi = groups.chi_square(df, row, column)
    off = F.abs(F.col("observed") - F.col("expected"))
    yates = cells.agg(
        F.sum(F.pow(off - F.least(F.lit(0.5), off), 2.0) / F.col("expected")).alias("_yates"),
        F.transform(F.sort_array(F.collect_list(F.struct("row_label", "col_label", "observed"))), lambda s: s["observed"]).alias("_cells"),  # cells of two category columns
    )
    one = chi.join(F.broadcast(yates)).withColumn("_small", (F.col("df") == 1) & (F.col("least_expected") < 5))
    one = one.withColumn("statistic", F.when(F.col("_small"), None).when(F.col("df") == 1, F.col("_yates")).otherwise(F.col("chi2")))
    for i, c in enumerate("abcd"):
        one = one.withColumn(f"_{c}", F.when(F.col("_small"), F.get("_cells", F.lit(i))))
    one = groups.with_p(groups.with_p(one, "chi2", "statistic", "df", to="_p_chi"), "fisher", "_a", "_b", "_c", "_d", to="_p_fisher")
    return one.select("n", F.when(F.col("_small"), "fisher").otherwise("chi2").alias("route"), "statistic", "df", F.when(F.col("_small"), F.col("_p_fisher")).otherwise(F.col("_p_chi")).alias("p_value"), "least_expected", "cramers_v")


def trend_test(df: DataFrame, order: str, value: str, by: Sequence[str], alpha: float = 0.05) -> DataFrame:
    """Mann-Kendall with its p, the Theil-Sen slope with its 95 % interval, and the direction; series of at least 4 values.

    A null key is a series of its own; a series without two different places in its order is left out.
    """
    found = series.sloped(df, order, value, list(by)).where("_n >= 4 and _pairs > 0").withColumn("_z", series.kendall_z())
    found = groups.with_p(found, "normal", "_z", to="_p_value")
    direction = F.when(F.col("_p_value") >= alpha, "none").when(F.col("_z") > 0, "increasing").otherwise("decreasing")
    names = ("n", "score", "z", "p_value", "tau_b", "slope", "intercept", "low", "high")
    return found.select(*by, *(F.col(f"_{c}").alias(c) for c in names), direction.alias("direction"))


def compare_composition(counts: DataFrame, labels: DataFrame, metric: str = "braycurtis", replicates: int = 999) -> dict[str, DataFrame]:
    """Distances of all pairs of samples, their permanova, and Shannon's index compared between the levels of (sample, level).

    Samples without a label are one level, ungrouped.  The index is only tested if every level has 3 samples; otherwise its row is refused.
    """
    own = labels.select("sample", F.col("level").cast("string").alias("level"))
    named = counts.select("sample").distinct().join(own, "sample", "left").withColumn("level", F.coalesce("level", F.lit("ungrouped")))
    distances = diversity.beta(counts, metric)
    index = diversity.alpha(counts).select("sample", "shannon").join(named, "sample")
    return {"distances": distances, "permanova": diversity.permanova(distances, named, replicates), "shannon": compare_groups(index, "level", "shannon")}
