"""How far a result holds: intervals of effects, stability under left-out and redrawn observations, one-sample tests, sentences.

Rows are a bounded sample with a dense index (``resample.indexed``).  Replicates are reduced to sums per
group in the JVM; only one row a replicate meets Python, for its p-value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.functions.columns import draw, finite, meet, ratio, running
from skerry.functions.shared import written
from skerry.operators.groups import signed_ranks, with_p
from skerry.operators.resample import HELD, SEED, bootstrap, indexed, numbers, percentile_interval, redrawn_sums, replicated, tasks_of


def _slots(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Rows with their place and the size within their group; places are counted over ranges, written once."""
    named = rows.select(F.col(group).alias("group_label"), "idx", F.col(value).cast("double").alias("v"))
    sizes = named.groupBy("group_label").agg(F.count("*").alias("size"))
    placed = running(named, ["group_label"], ["idx"], slot=("sum", F.lit(1))).withColumn("slot", F.col("slot") - 1)
    return written(meet(placed, sizes, ["group_label"]), "slots")


def redrawn(rows: DataFrame, group: str, value: str, replicates: int, seed: int = SEED) -> DataFrame:
    """Sums (replicate, group_label, n, s, q) of samples with replacement within each group; rows without a group take no part."""
    return _redrawn(_slots(rows, group, value), replicates, seed)


def _redrawn(slots: DataFrame, replicates: int, seed: int) -> DataFrame:
    spark, slots, kind = slots.sparkSession, slots.where("group_label is not null"), slots.schema["group_label"].dataType
    n = slots.count()
    if 0 < n <= HELD:
        held = slots.select(F.col("group_label").cast("string").alias("label"), "slot", F.coalesce("v", F.lit(0.0)).alias("v"), F.col("v").isNotNull().alias("there")).toPandas().sort_values(["label", "slot"])
        parts = [(f"{label}|", g["v"].to_numpy(float), g["there"].to_numpy(bool)) for label, g in held.groupby("label")]
        labels = F.array(*(F.lit(label[:-1]) for label, _, _ in parts))
        found = redrawn_sums(spark, parts, replicates, seed)
        value = lambda c: F.when(F.col("m") > 0, F.col(c)).alias(c)
        return found.select("replicate", F.get(labels, F.col("part")).cast(kind).alias("group_label"), "n", value("s"), value("q"))
    spread = slots.select("group_label", "slot", "size").repartition(tasks_of(n, replicates), "group_label", "slot")
    drawn = replicated(spread, numbers(slots, replicates)).select("replicate", "group_label", (draw(seed, F.col("replicate"), F.col("group_label"), F.col("slot")) % F.col("size")).alias("slot"))
    found = drawn.join(slots.select("group_label", "slot", "v").hint("shuffle_hash"), ["group_label", "slot"])
    return found.groupBy("replicate", "group_label").agg(F.count("*").alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"))


def effect_interval(rows: DataFrame, group: str, value: str, a: str, b: str, replicates: int = 999, confidence: float = 0.95, seed: int = SEED) -> DataFrame:
    """Percentile interval of Hedges' g of a against b, each redrawn on its own."""
    sums = redrawn(rows.where(F.col(group).isin(a, b)), group, value, replicates, seed)
    wide = sums.groupBy("replicate").agg(*(F.max(F.when(F.col("group_label") == g, F.col(c))).alias(f"{c}_{k}") for g, k in ((a, "a"), (b, "b")) for c in ("n", "s", "q")))
    n, m = F.col("n_a"), F.col("n_b")
    spread = (F.col("q_a") - F.col("s_a") * F.col("s_a") / n) + (F.col("q_b") - F.col("s_b") * F.col("s_b") / m)
    d = ratio(F.col("s_a") / n - F.col("s_b") / m, F.sqrt(F.greatest(spread, F.lit(0.0)) / (n + m - 2)), 0.0)
    return percentile_interval(wide.where("n_a + n_b > 3").select((d * (1 - 3.0 / (4 * (n + m - 2) - 1))).alias("statistic")), confidence)


def _f(sums: DataFrame, *by: str) -> DataFrame:
    """One-way F per ``by`` from rows of n, s, q."""
    t = sums.groupBy(*by).agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("between"))
    between, within = F.col("between") - F.col("s") * F.col("s") / F.col("n"), F.col("q") - F.col("between")
    f = ratio(between / (F.col("k") - 1), within / (F.col("n") - F.col("k")))
    return t.where("k > 1 and n > k").select(*by, f.alias("f"), (F.col("k") - 1).alias("d1"), (F.col("n") - F.col("k")).alias("d2"))


def stability(rows: DataFrame, group: str, value: str, replicates: int = 400, alpha: float = 0.05, seed: int = SEED) -> DataFrame:
    """The one-way test again without each observation and on redrawn groups: agreement with the full verdict, and a severity.

    block if leaving out one observation flips the verdict or under 70 % of the replicates agree, warn below 90 %.
    Constant replicates have no F and are skipped.
    """
    slots = _slots(rows, group, value)
    sums = slots.groupBy("group_label").agg(F.count("*").alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"))
    labels = sums.withColumnsRenamed({"group_label": "g"})
    out = slots.select("idx", "group_label", "v").join(F.broadcast(labels))  # groups of one comparison
    own = (F.col("group_label") == F.col("g")).cast("int")
    out = out.select(F.col("idx").alias("replicate"), (F.col("n") - own).alias("n"), (F.col("s") - own * F.col("v")).alias("s"), (F.col("q") - own * F.col("v") * F.col("v")).alias("q")).where("n > 0")
    parts = _f(sums.withColumn("replicate", F.lit(0)), "replicate").withColumn("kind", F.lit("full"))
    parts = parts.unionByName(_f(out, "replicate").withColumn("kind", F.lit("left_out"))).unionByName(_f(_redrawn(slots, replicates, seed), "replicate").withColumn("kind", F.lit("redrawn")))
    tests = with_p(parts.where("f is not null"), "f", "f", "d1", "d2").withColumn("verdict", F.col("p_value") < alpha)
    full = tests.where("kind = 'full'").select(F.col("verdict").alias("full_verdict"), F.col("p_value").alias("full_p"))
    t = tests.where("kind <> 'full'").join(F.broadcast(full)).withColumn("agrees", F.col("verdict") == F.col("full_verdict"))
    s = t.groupBy("full_p").agg(
        F.avg(F.col("agrees").cast("double")).alias("agreement"), F.count_if((F.col("kind") == "left_out") & ~F.col("agrees")).alias("flips"),
        F.max_by("replicate", F.when(F.col("kind") == "left_out", F.abs(F.col("p_value") - F.col("full_p")))).alias("most_influential"), F.count_if(F.col("kind") == "redrawn").alias("redrawn"),
    )
    return s.withColumn("severity", F.when((F.col("flips") > 0) | (F.col("agreement") < 0.7), "block").when(F.col("agreement") < 0.9, "warn").otherwise("info"))


def one_sample(rows: DataFrame, value: str, mu: float = 0.0, replicates: int = 999) -> DataFrame:
    """Wilcoxon against ``mu`` below 10 values, else t; Cohen's d and a bootstrap interval of the mean.  Under 3 values are refused."""
    x = indexed(finite(rows, value).withColumnRenamed("idx", "_at"), "_at", value)
    s = x.agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    t = with_p(s.withColumn("t", ratio(F.col("mean") - mu, F.col("sd") / F.sqrt("n"))).withColumn("df", F.col("n") - 1), "t", "t", "df", to="p_t")
    w = with_p(signed_ranks(x.select(F.col(value).cast("double").alias("x"), F.lit(float(mu)).alias("m")), "x", "m"), "wilcoxon", "w_plus", "n", "tie_term", to="p_w").select("w_plus", "p_w")
    ci = percentile_interval(bootstrap(x, value, replicates)).select("low", "high")
    small = F.col("n") < 10
    row = t.join(F.broadcast(w)).join(F.broadcast(ci))  # one row each
    refused = F.col("n") < 3
    keep = lambda c: F.when(~refused, c)
    return row.select("n", "mean", F.when(small, "wilcoxon").otherwise("ttest").alias("route"), keep(F.when(small, F.col("w_plus")).otherwise(F.col("t"))).alias("statistic"), keep(F.when(small, F.col("p_w")).otherwise(F.col("p_t"))).alias("p_value"), keep(ratio(F.col("mean") - mu, F.col("sd"))).alias("cohens_d"), keep(F.col("low")).alias("low"), keep(F.col("high")).alias("high"), refused.alias("refused"))


def histogram(df: DataFrame, value: str, bins: int = 40) -> DataFrame:
    """Counts of equal-width bins between the least and the greatest value; the last bin includes its end."""
    x = finite(df, value)
    ends = x.agg(F.min(value).alias("low"), F.max(value).alias("high"))
    at = F.when(F.col("high") > F.col("low"), F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("low")) / (F.col("high") - F.col("low")) * bins))).otherwise(0).cast("int")
    return x.join(F.broadcast(ends)).select(at.alias("bin"), "low", "high").groupBy("bin", "low", "high").agg(F.count("*").alias("n")).select("bin", (F.col("low") + F.col("bin") * (F.col("high") - F.col("low")) / bins).alias("from_value"), "n")


def long_series(df: DataFrame, time: str, *series: str) -> DataFrame:
    """(time, series, value) of wide columns, finite values only."""
    return finite(df.unpivot([time], list(series), "series", "value"), "value")


def sentence(p: Column, effect: Column, size: Column, alpha: float = 0.05) -> Column:
    """What a comparison says, from its computed numbers only."""
    verdict = F.when(p < alpha, "A difference this large would be unusual if the groups were the same").otherwise("This experiment did not find a difference, which does not show that there is none")
    return F.concat(verdict, F.format_string(" (p = %.4f, effect %.3f, ", p, effect), size, F.lit(")."))
