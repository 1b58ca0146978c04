"""Curve fits of many series at once: one Arrow group a series, numpy least squares with bounds."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Shape:
    """A model: its function, parameter names, and a first guess from the data; parameters in ``positive`` stay above 0."""

    call: Callable
    names: tuple[str, ...]
    guess: Callable
    positive: tuple[str, ...] = ()


def _safe_exp(x):
    return np.exp(np.clip(x, -700, 700))


SHAPES = {
    "linear": Shape(lambda x, a, b: a + b * x, ("intercept", "slope"), lambda x, y: np.polyfit(x, y, 1)[::-1]),
    "exponential": Shape(lambda x, a, k: a * _safe_exp(k * x), ("start", "rate"), lambda x, y: (max(y[0], 1e-6), math.log(max(y[-1], 1e-6) / max(y[0], 1e-6)) / max(x[-1] - x[0], 1e-9))),
    "logistic_growth": Shape(lambda x, k, r, m: k / (1 + _safe_exp(-r * (x - m))), ("capacity", "rate", "midpoint"), lambda x, y: (y.max() * 1.05, 4 / max(np.ptp(x), 1e-9), x[np.abs(y - y.max() / 2).argmin()]), ("capacity", "rate")),
    "gompertz": Shape(lambda x, k, r, m: k * _safe_exp(-_safe_exp(-r * (x - m))), ("capacity", "rate", "midpoint"), lambda x, y: (y.max() * 1.05, 3 / max(np.ptp(x), 1e-9), x[np.abs(y - y.max() * 0.37).argmin()]), ("capacity", "rate")),
    "michaelis_menten": Shape(lambda x, v, k: v * x / (k + x), ("maximum", "half"), lambda x, y: (y.max() * 1.2, max(float(np.median(x)), 1e-9)), ("maximum", "half")),
    "four_pl": Shape(lambda x, a, d, c, b: d + (a - d) / (1 + (np.maximum(x, 1e-12) / c) ** b), ("low_end", "high_end", "middle", "slope"), lambda x, y: (y[np.argmin(x)], y[np.argmax(x)], max(float(np.median(x)), 1e-9), 1.0), ("middle",)),
    "optimum": Shape(lambda x, h, c, w: h * _safe_exp(-((x - c) ** 2) / (2 * w * w)), ("height", "centre", "width"), lambda x, y: (y.max(), x[y.argmax()], max(np.ptp(x) / 4, 1e-9)), ("width",)),
}


def least_squares(shape: Shape, x: np.ndarray, y: np.ndarray, start, steps: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """Levenberg-Marquardt with a numeric Jacobian and projection on the bounds: parameters, Jacobian, sum of squares."""
    p = np.asarray(start, float).copy()
    low = np.array([1e-12 if n in shape.positive else -np.inf for n in shape.names])
    p = np.maximum(p, low)
    damp = 1e-3
    with np.errstate(all="ignore"):
        residual = y - shape.call(x, *p)
        cost = float(residual @ residual)
        jacobian = np.zeros((len(x), len(p)))
        for _ in range(steps):
            for k in range(len(p)):
                h = 1e-6 * max(abs(p[k]), 1e-6)
                q = p.copy()
                q[k] += h
                jacobian[:, k] = (shape.call(x, *q) - shape.call(x, *p)) / h
            a, g = jacobian.T @ jacobian, jacobian.T @ residual
            moved = False
            for _ in range(12):
                try:
                    step = np.linalg.solve(a + damp * np.diag(np.maximum(np.diag(a), 1e-12)), g)
                except np.linalg.LinAlgError:
                    damp *= 10
                    continue
                q = np.maximum(p + step, low)
                r = y - shape.call(x, *q)
                c = float(r @ r)
                if np.isfinite(c) and c < cost:
                    moved = cost - c > 1e-14 * max(cost, 1e-300)
                    p, residual, cost, damp = q, r, c, max(damp / 5, 1e-12)
                    break
                damp *= 5
            if not moved:
                break
    return p, jacobian, cost


def aicc(n: int, k: int, cost: float) -> float:
    """Corrected Akaike criterion with k parameters and the error variance."""
    m = k + 1
    return n * math.log(max(cost, 1e-300) / n) + 2 * m + (2 * m * (m + 1) / (n - m - 1) if n - m - 1 > 0 else math.inf)


_FIT = "model string, parameter string, estimate double, se double, r2 double, rmse double, aicc double, n int"


def fit(df: DataFrame, series: str, x: str, y: str, models: list[str]) -> DataFrame:
    """Parameters of every model for every series; series with fewer than parameters + 1 points give no row."""
    kind = dict(df.dtypes)[series]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        a = pdf[[x, y]].astype(float).to_numpy()
        a = a[np.isfinite(a).all(axis=1)]
        a = a[np.argsort(a[:, 0], kind="stable")]
        rows, n = [], len(a)
        for name in models:
            shape = SHAPES[name]
            k = len(shape.names)
            if n < k + 1 or len(np.unique(a[:, 0])) < 2:
                continue
            p, j, cost = least_squares(shape, a[:, 0], a[:, 1], shape.guess(a[:, 0], a[:, 1]))
            spread = ((a[:, 1] - a[:, 1].mean()) ** 2).sum()
            se = np.sqrt(np.maximum(np.diag(np.linalg.pinv(j.T @ j)) * cost / max(n - k, 1), 0))
            for label, value, error in zip(shape.names, p, se):
                rows.append((key[0], name, label, float(value), float(error), 1 - cost / spread if spread else np.nan, math.sqrt(cost / n), aicc(n, k, cost), n))
        return pd.DataFrame(rows, columns=[series, "model", "parameter", "estimate", "se", "r2", "rmse", "aicc", "n"])

    return df.select(series, x, y).groupBy(series).applyInPandas(run, f"`{series}` {kind}, {_FIT}")


def compare_models(df: DataFrame, series: str, x: str, y: str, models: list[str]) -> DataFrame:
    """Per series and model (a line always among them): AICc, its distance to the best, Akaike weight, and whether the best is worth its curve.

    A curve is worth it if the line's AICc is more than 4 above the best one.
    """
    from skerry.operators.series import akaike

    fitted = fit(df, series, x, y, list(dict.fromkeys(["linear", *models]))).select(series, "model", "aicc", "r2", "n").distinct()
    ranked = akaike(fitted, "aicc", [series])
    line = F.max(F.when(F.col("model") == "linear", F.col("delta"))).over(Window.partitionBy(series))
    return ranked.withColumn("best", F.col("delta") == 0).withColumn("worth_it", F.coalesce(line > 4, F.lit(False)))


def bootstrap_fit(df: DataFrame, series: str, x: str, y: str, model: str, replicates: int = 200, seed: int = 20260901) -> DataFrame:
    """Percentile intervals of a model's parameters from pair bootstraps, in parallel over (series, replicate).

    Replicates with too few different x are skipped.
    """
    from pyspark.sql import Window

    from skerry.functions.columns import draw

    kind = dict(df.dtypes)[series]
    rows = df.select(series, x, y).withColumn("_i", F.row_number().over(Window.partitionBy(series).orderBy(x, y)) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(series)))
    drawn = rows.select(series, F.col("_i").alias("_slot"), "_n", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("_b")).withColumn("_i", (draw(seed, F.col("_b"), F.col("_slot")) % F.col("_n")).cast("int"))
    sample = drawn.select(series, "_b", "_i").join(rows.select(series, "_i", x, y), [series, "_i"])
    shape = SHAPES[model]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        a = pdf[[x, y]].astype(float).sort_values(x).to_numpy()
        if len(np.unique(a[:, 0])) < len(shape.names) + 1:
            return pd.DataFrame({series: [], "parameter": [], "estimate": []})
        p, _, _ = least_squares(shape, a[:, 0], a[:, 1], shape.guess(a[:, 0], a[:, 1]))
        return pd.DataFrame({series: key[0], "parameter": shape.names, "estimate": p})

    found = sample.groupBy(series, "_b").applyInPandas(run, f"`{series}` {kind}, parameter string, estimate double")
    return found.groupBy(series, "parameter").agg(F.percentile("estimate", 0.025).alias("low"), F.percentile("estimate", 0.975).alias("high"), F.count("*").alias("fits"))
