"""Community diversity over sparse counts (sample, taxon, n)."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skerry.functions.columns import ratio
from skerry.operators.resample import SEED


def alpha(counts: DataFrame) -> DataFrame:
    """Per sample: observed taxa, total, Shannon, Simpson, inverse Simpson, Pielou, singletons, doubletons, Chao1.

    A sample whose counts are all 0 has 0 observed taxa and Shannon 0.0, so that it can be compared on.
    """
    rows = counts.groupBy("sample", "taxon").agg(F.sum("n").cast("double").alias("n"))
    s = rows.groupBy("sample").agg(
        F.count_if(F.col("n") > 0).alias("observed"), F.sum("n").alias("total"), F.sum(F.when(F.col("n") > 0, F.col("n") * F.ln("n")).otherwise(0.0)).alias("nln"),
        F.sum(F.col("n") * F.col("n")).alias("squares"), F.count_if(F.col("n") == 1).alias("f1"), F.count_if(F.col("n") == 2).alias("f2"),
    )
    n = F.col("total")
    shannon = F.when(n > 0, F.ln(n) - F.col("nln") / n).otherwise(0.0)
    concentration = ratio(F.col("squares"), n * n)
    return s.select(
        "sample", "observed", "total", shannon.alias("shannon"), (1 - concentration).alias("simpson"), ratio(F.lit(1.0), concentration).alias("inverse_simpson"),
        F.when(F.col("observed") > 1, shannon / F.ln("observed")).alias("pielou"), "f1", "f2", (F.col("observed") + F.col("f1") * (F.col("f1") - 1) / (2.0 * (F.col("f2") + 1))).alias("chao1"),
    )


def clr(counts: DataFrame, pseudocount: float = 0.5) -> DataFrame:
    """Centred log ratios over all taxa of the table; absent taxa count as 0."""
    rows = counts.groupBy("sample", "taxon").agg(F.sum("n").cast("double").alias("n"))
    taxa = rows.select("taxon").distinct()
    full = rows.select("sample").distinct().crossJoin(taxa).join(rows, ["sample", "taxon"], "left")  # the dense table is the result
    log = F.ln(F.coalesce("n", F.lit(0.0)) + F.lit(float(pseudocount)))
    return full.withColumn("_log", log).withColumn("clr", F.col("_log") - F.avg("_log").over(Window.partitionBy("sample"))).select("sample", "taxon", "clr")


def beta(counts: DataFrame, metric: str = "braycurtis") -> DataFrame:
    """Distances (a, b, distance) of all pairs of samples a < b: braycurtis (on shares), jaccard or aitchison.

    Samples meet on the taxa that they share; what only one has follows from its total.
    """
    if metric == "aitchison":
        v = clr(counts)
        x, y = v.select(F.col("sample").alias("a"), "taxon", F.col("clr").alias("x")), v.select(F.col("sample").alias("b"), "taxon", F.col("clr").alias("y"))
        return x.join(y, "taxon").where("a < b").groupBy("a", "b").agg(F.sqrt(F.sum((F.col("x") - F.col("y")) ** 2)).alias("distance"))
    if metric not in ("braycurtis", "jaccard"):
        raise ValueError(f"unknown metric {metric!r}")
    rows = counts.where("n > 0").groupBy("sample", "taxon").agg(F.sum("n").cast("double").alias("n"))
    rows = rows.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("sample")))
    x, y = rows.select(F.col("sample").alias("a"), "taxon", F.col("share").alias("x")), rows.select(F.col("sample").alias("b"), "taxon", F.col("share").alias("y"))
    common = x.join(y, "taxon").where("a < b").groupBy("a", "b").agg(F.sum(F.least("x", "y")).alias("least"), F.count("*").alias("both"))
    sizes = rows.groupBy("sample").agg(F.count("*").alias("taxa"))
    names = sizes.select(F.col("sample").alias("a"), F.col("taxa").alias("taxa_a")).join(sizes.select(F.col("sample").alias("b"), F.col("taxa").alias("taxa_b")), F.col("a") < F.col("b"))
    found = names.join(common, ["a", "b"], "left")
    both = F.coalesce("both", F.lit(0))
    distance = 1 - F.coalesce("least", F.lit(0.0)) if metric == "braycurtis" else 1 - both / (F.col("taxa_a") + F.col("taxa_b") - both)
    return found.select("a", "b", distance.cast("double").alias("distance"))


def _pseudo_f(within: Column, total: Column, n: int, levels: int) -> Column:
    return ((total - within) / (levels - 1)) / (within / (n - levels))


def permanova(distances: DataFrame, labels: DataFrame, replicates: int = 999, seed: int = SEED) -> DataFrame:
    """Pseudo-F, p = (c + 1) / (B + 1) and R squared of (sample, level) labels over distances (a, b, distance).

    Each replicate permutes the labels in md5 order; all replicates are one aggregation.
    """
    n, levels = labels.count(), labels.select("level").distinct().count()
    if n < 6 or levels < 2 or n <= levels:
        raise ValueError("at least 6 samples and 2 levels are needed")
    named = labels.select("sample", "level", F.row_number().over(Window.orderBy("sample")).alias("idx"))  # samples of one study
    drawn = labels.sparkSession.range(-1, replicates).select(F.col("id").alias("replicate")).join(F.broadcast(named.select("sample", "idx")))
    key = F.when(F.col("replicate") < 0, F.lpad(F.col("idx").cast("string"), 12, "0")).otherwise(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("replicate").cast("string"), F.col("idx").cast("string"))))
    drawn = drawn.withColumn("slot", F.row_number().over(Window.partitionBy("replicate").orderBy(key, "idx")))
    drawn = drawn.join(F.broadcast(named.select(F.col("idx").alias("slot"), "level")), "slot").select("replicate", "sample", "level")
    sizes = labels.groupBy("level").agg(F.count("*").alias("size"))
    x, y = drawn.select("replicate", F.col("sample").alias("a"), F.col("level").alias("la")), drawn.select("replicate", F.col("sample").alias("b"), F.col("level").alias("lb"))
    inside = distances.join(x, "a").join(y, ["replicate", "b"]).where("la = lb").join(F.broadcast(sizes.withColumnRenamed("level", "la")), "la")
    within = inside.groupBy("replicate").agg(F.sum(F.col("distance") ** 2 / F.col("size")).alias("within"))
    total = distances.agg((F.sum(F.col("distance") ** 2) / F.lit(float(n))).alias("total"))
    f = within.join(F.broadcast(total)).withColumn("f", _pseudo_f(F.col("within"), F.col("total"), n, levels))
    observed = f.where("replicate < 0").select(F.col("f").alias("observed"))
    p = (F.count_if((F.col("replicate") >= 0) & (F.col("f") >= F.col("observed") - 1e-9)) + 1) / F.lit(float(replicates + 1))
    found = f.join(F.broadcast(observed)).groupBy("observed").agg(p.alias("p_value"))
    r2 = F.col("observed") / (F.col("observed") + F.lit(float(n - levels)) / F.lit(float(levels - 1)))
    return found.select(F.col("observed").alias("pseudo_f"), "p_value", r2.alias("r_squared"))


def pcoa(distances: DataFrame, axes: int = 3) -> DataFrame:
    """Principal coordinates (sample, axis, coordinate, explained) of one study's distances, by double centring."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted({*pdf["a"], *pdf["b"]})
        at = {k: i for i, k in enumerate(names)}
        d = np.zeros((len(names), len(names)))
        i, j = pdf["a"].map(at), pdf["b"].map(at)
        d[i, j] = d[j, i] = pdf["distance"]
        c = np.eye(len(names)) - 1 / len(names)
        values, vectors = np.linalg.eigh(-c @ (d * d) @ c / 2)
        order = np.argsort(values)[::-1][:axes]
        positive = values[values > 0].sum() or 1.0
        return pd.DataFrame([(n, k + 1, float(vectors[r, o] * max(values[o], 0) ** 0.5), float(max(values[o], 0) / positive)) for k, o in enumerate(order) for r, n in enumerate(names)], columns=["sample", "axis", "coordinate", "explained"])

    return distances.select(F.col("a").cast("string"), F.col("b").cast("string"), "distance", F.lit(0).alias("_all")).groupBy("_all").applyInPandas(run, "sample string, axis int, coordinate double, explained double")  # one dense matrix


#: Up to this many factors a share's product is taken factor by factor, beyond through log-gamma.
MOST_FACTORS = 4_000_000


def _absent(total: int, depth: int, most: int) -> Callable[[np.ndarray], np.ndarray]:
    """How likely ``depth`` individuals of ``total`` hold none of m given ones, for m up to ``most``."""
    if most <= MOST_FACTORS:
        t = np.arange(min(most, max(total - depth, 0)))
        table = np.zeros(most + 1)
        table[: len(t) + 1] = np.exp(np.concatenate([[0.0], np.cumsum(np.log((total - depth - t) / (total - t)))]))
        return lambda m: table[m]
    lg = np.frompyfunc(math.lgamma, 1, 1)

    def share(m: np.ndarray) -> np.ndarray:
        m = np.asarray(m, float)
        left = np.maximum(total - depth - m, 0)
        log = (lg(total - m + 1) - lg(left + 1) - math.lgamma(total + 1) + math.lgamma(total - depth + 1)).astype(float)
        return np.where(total - depth >= m, np.exp(log), 0.0)

    return share


def rarefaction(counts: DataFrame, points: int = 20) -> DataFrame:
    """(sample, depth, expected, sd, low, high): expected taxa at evenly spaced depths, with a band of 95 %, exactly.

    A subsample lacks a taxon of n individuals with C(N - n, d) / C(N, d), and two taxa with n + m in place of n.  Taxa of
    the same abundance are one class, at most the root of 2 N of a sample; each class is a row, which meets the others of
    its sample as an array, so that neither taxa nor classes are joined in pairs.

    Counts of one taxon are added up; null or non-positive ones are left out, a null sample is a sample, and a sample
    without individuals has no curve.
    """
    taxa = counts.groupBy(F.col("sample").cast("string").alias("_s"), "taxon").agg(F.sum("n").cast("long").alias("_n")).where("_n > 0")
    classes = taxa.groupBy("_s", "_n").agg(F.count("*").alias("_f"))
    whole = classes.groupBy(F.col("_s").alias("_of")).agg(F.array_sort(F.collect_list(F.struct("_n", "_f"))).alias("_all"))

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for sample, a, f, classes in pdf.itertuples(index=False):
                n, times = (np.array([c[k] for c in classes], np.int64) for k in ("_n", "_f"))
                total, later = int((n * times).sum()), n > a
                for depth in np.unique(np.linspace(1, total, points).astype(int)):
                    share = _absent(total, int(depth), int(2 * n.max()))
                    q, other = share(np.array([a]))[0], share(n[later])
                    both = share(n[later] + a) - q * other
                    spread = f * q * (1 - q) + f * (f - 1) * (share(np.array([2 * a]))[0] - q * q) + 2 * f * float((times[later] * both).sum())
                    out.append((sample, int(depth), f * (1 - q), spread))
            yield pd.DataFrame(out, columns=["sample", "depth", "e", "v"])

    rows = classes.join(whole, F.col("_s").eqNullSafe(F.col("_of"))).select("_s", "_n", "_f", "_all")
    curve = rows.mapInPandas(parts, "sample string, depth long, e double, v double").groupBy("sample", "depth").agg(F.sum("e").alias("expected"), F.sqrt(F.greatest(F.sum("v"), F.lit(0.0))).alias("sd"))
    reach = F.lit(1.959963984540054) * F.col("sd")
    return curve.select("sample", "depth", "expected", "sd", F.greatest(F.col("expected") - reach, F.lit(0.0)).alias("low"), (F.col("expected") + reach).alias("high"))


def saturation(curve: DataFrame) -> DataFrame:
    """Per sample of a rarefaction curve: its slope over the last fifth, over the first step, and whether it has levelled off.

    It has if the last slope is under a tenth of the first; a curve of one point has none.
    """
    w = Window.partitionBy("sample").orderBy("depth")  # the points of one curve
    placed = curve.withColumn("_i", F.row_number().over(w)).withColumn("_m", F.count("*").over(Window.partitionBy("sample")))
    back = F.greatest(F.lit(2), F.floor(F.col("_m") / 5))
    at = lambda place, c: F.max(F.when(F.col("_i") == place, F.col(c)))
    s = placed.groupBy("sample", "_m").agg(*(at(place, c).alias(f"_{c}{k}") for k, place in (("a", F.lit(1)), ("b", F.lit(2)), ("y", F.col("_m") - back + 1), ("z", F.col("_m"))) for c in ("depth", "expected")))
    rise = lambda x, y: (F.col(f"_expected{y}") - F.col(f"_expected{x}")) / F.greatest(F.lit(1), F.col(f"_depth{y}") - F.col(f"_depth{x}"))
    s = s.where("_m > 1").withColumns({"end_slope": rise("y", "z"), "first_slope": rise("a", "b")})
    return s.select("sample", "end_slope", "first_slope", (F.col("end_slope") < 0.1 * F.greatest(F.col("first_slope"), F.lit(1e-12))).alias("saturated"))
