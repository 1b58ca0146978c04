"""Bench arithmetic over rows of a DataFrame."""

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.functions import special
from skerry.functions.columns import ratio


def dilution_series(spark: SparkSession, start: float = 1e9, fold: float = 10.0, steps: int = 8, transferred: float = 0.1, diluent: float = 0.9) -> DataFrame:
    """Tubes 0 to ``steps``: nominal and actual concentration, and whether 0.1 mL gives 30 to 300 plaques."""
    actual = (transferred + diluent) / transferred
    t = spark.range(steps + 1).select(F.col("id").cast("int").alias("tube"))
    real = F.lit(start) / F.pow(F.lit(actual), F.col("tube"))
    return t.select("tube", F.pow(F.lit(float(fold)), F.col("tube")).alias("dilution_factor"), (F.lit(start) / F.pow(F.lit(float(fold)), F.col("tube"))).alias("nominal"), real.alias("concentration"), (real * 0.1).between(30, 300).alias("countable"))


def wilson(successes: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson's interval of a proportion."""
    p, scale = successes / n, 1 + z * z / n
    middle, reach = (p + z * z / (2 * n)) / scale, z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / scale
    return middle - reach, middle + reach


def _intervals(counts: pd.Series) -> pd.DataFrame:
    found = {x: special.poisson_interval(int(x)) for x in counts.unique()}
    return pd.DataFrame([found[x] for x in counts], columns=["low", "high"])


def poisson_interval(counts: Column) -> Column:
    """Exact interval (low, high) of Poisson counts, one row a plate; equal counts of a batch are worked out once."""
    return F.pandas_udf(_intervals, "struct<low:double,high:double>")(counts)


def titre(df: DataFrame, count: str, dilution: str, volume: str) -> DataFrame:
    """Titre of each plate with its exact interval and whether 30 to 300 plaques make the count good."""
    unit = F.col(dilution) / F.col(volume)
    ci = poisson_interval(F.col(count).cast("long"))
    rows = df.withColumn("_ci", ci)
    quality = F.when(F.col(count) == 0, "none").when(F.col(count) < 30, "too_few").when(F.col(count) > 300, "too_many").otherwise("good")
    return rows.withColumn("titre", F.col(count) * unit).withColumn("low", F.col("_ci.low") * unit).withColumn("high", F.col("_ci.high") * unit).withColumn("quality", quality).drop("_ci")


def pooled_titre(df: DataFrame, count: str, dilution: str, volume: str, by: list[str]) -> DataFrame:
    """Pooled estimate: sum of counts over sum of undiluted volumes, and the chi-square of the plates around it."""
    undiluted = F.col(volume) / F.col(dilution)
    rows = df.withColumn("_v", undiluted)
    s = rows.groupBy(*by).agg(F.sum(count).alias("plaques"), F.sum("_v").alias("_volume"), F.sum(F.col(count) * F.col(count) / F.col("_v")).alias("_squares"), F.count("*").alias("plates"))
    pooled = ratio(F.col("plaques"), F.col("_volume"))
    chi2 = F.col("_squares") / pooled - F.col("plaques")
    return s.select(*by, "plates", "plaques", pooled.alias("titre"), F.when(F.col("plaques") > 0, chi2).alias("chi2"), (F.col("plates") - 1).alias("df"))


def infection(df: DataFrame, phage: str, bacteria: str) -> DataFrame:
    """Multiplicity of infection and the Poisson shares of cells with 0, 1 and more phages."""
    m = ratio(F.col(phage), F.col(bacteria))
    none, one = F.exp(-m), m * F.exp(-m)
    regime = F.when(m < 0.1, "low").when(m < 3, "medium").otherwise("high")
    return df.withColumn("moi", m).withColumn("uninfected", none).withColumn("single", one).withColumn("multiple", 1 - none - one).withColumn("regime", regime)
