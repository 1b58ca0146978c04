"""Simulations, one row of parameters (or one run) a simulation, in parallel over rows."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skerry.functions import special

# Default parameters of the population models.
DEFAULTS = {"mu": 0.7, "K": 1e9, "adsorption": 1e-9, "burst": 100.0, "latent": 0.5, "decay": 0.05, "n_stages": 15, "lysogeny": 0.1, "induction": 0.001, "resistance": 1e-7, "cost": 0.1, "Ks": 1e6, "dilution": 0.2, "inflow": 1e9, "yield_coeff": 1e6}
TYPICAL = {"mu": (0.2, 1.5), "K": (1e8, 1e10), "adsorption": (1e-10, 1e-8), "burst": (20, 200), "latent": (0.3, 1.5), "decay": (0.0, 0.2), "n_stages": (8, 25), "lysogeny": (0.0, 0.5), "induction": (1e-4, 1e-2), "resistance": (1e-9, 1e-6), "cost": (0.0, 0.3)}
MODELS = ("lytic", "lysogenic", "resistance", "chemostat")


def rates(model: str, p: dict, y: np.ndarray) -> np.ndarray:
    """Time derivative of the state: cells, chain of infected stages, phages, then the model's own (lysogens, resistant cells, nutrient)."""
    k = int(p["n_stages"])
    s, stages, v = y[0], y[1 : 1 + k], y[1 + k]
    out = np.zeros_like(y)
    infected = stages.sum()
    meet = p["adsorption"] * s * v
    flow = k / p["latent"]
    others = infected + s + (y[2 + k] if model in ("lysogenic", "resistance") else 0.0)
    growth = p["mu"] * (1 - others / p["K"])
    enter = meet
    if model == "lytic":
        out[0] = growth * s - meet
    elif model == "lysogenic":
        enter = (1 - p["lysogeny"]) * meet + p["induction"] * y[2 + k]
        out[0] = growth * s - meet
        out[2 + k] = growth * y[2 + k] + p["lysogeny"] * meet - p["induction"] * y[2 + k]
    elif model == "resistance":
        out[0] = growth * s * (1 - p["resistance"]) - meet
        out[2 + k] = growth * (1 - p["cost"]) * y[2 + k] + growth * p["resistance"] * s
    else:
        nutrient = max(y[2 + k], 0.0)
        monod = p["mu"] * nutrient / (p["Ks"] + nutrient)
        out[0] = monod * s - meet - p["dilution"] * s
        out[2 + k] = p["dilution"] * (p["inflow"] - nutrient) - monod * s / p["yield_coeff"] * 1e6
    out[1] = enter - flow * stages[0]
    out[2 : 1 + k] = flow * (stages[:-1] - stages[1:])
    out[1 + k] = p["burst"] * flow * stages[-1] - p["adsorption"] * (s + infected) * v - p["decay"] * v
    if model == "chemostat":
        out[1 : 2 + k] -= p["dilution"] * y[1 : 2 + k]
    return out


def integrate(model: str, p: dict, y: np.ndarray, times: np.ndarray, rtol: float = 1e-6, atol: float = 1e-3, longest: float = 0.1) -> np.ndarray:
    """Linearly implicit steps (Rosenbrock, order 2, L-stable) with a numeric Jacobian and an embedded error; states stay at 0 or more."""
    gamma = 1 + 1 / math.sqrt(2)
    found, t, h = [y.copy()], times[0], 1e-4
    for goal in times[1:]:
        while t < goal - 1e-12:
            h = min(h, longest, goal - t)
            f = rates(model, p, y)
            step = 1e-6 * np.maximum(np.abs(y), 1.0)
            jacobian = np.stack([(rates(model, p, y + np.eye(len(y))[i] * step[i]) - f) / step[i] for i in range(len(y))], axis=1)
            m = np.linalg.inv(np.eye(len(y)) - gamma * h * jacobian)
            k1 = m @ f
            k2 = m @ (rates(model, p, y + h * k1) - 2 * k1)
            new = y + 1.5 * h * k1 + 0.5 * h * k2
            error = np.abs(0.5 * h * (k1 + k2)) / (atol + rtol * 100 * np.maximum(np.abs(y), np.abs(new)))
            worst = float(error.max())
            if worst <= 1 or h < 1e-8:
                t, y = t + h, np.maximum(new, 0)
            h *= min(4.0, max(0.2, 0.9 / math.sqrt(max(worst, 1e-8))))
        found.append(y.copy())
    return np.stack(found)


def simulate(designs: DataFrame, model: str = "lytic", hours: float = 24.0, points: int = 100) -> DataFrame:
    """Trajectories (run_id, t, species, value) for rows with run_id, S0, P0 and any of the parameters; others have their default."""
    if model not in MODELS:
        raise ValueError(f"unknown model {model!r}")
    columns = [c for c in designs.columns if c in DEFAULTS]
    last = {"lysogenic": "Lysogens", "resistance": "Resistant", "chemostat": "Nutrient"}.get(model)

    def run(batches):
        times = np.linspace(0, hours, points)
        for pdf in batches:
            for row in pdf.to_dict("records"):
                p = DEFAULTS | {c: row[c] for c in columns if row[c] is not None and np.isfinite(row[c])}
                k = int(p["n_stages"])
                y = np.zeros(2 + k + (last is not None))
                y[0], y[1 + k] = row["S0"], row["P0"]
                if model == "chemostat":
                    y[2 + k] = p["inflow"]
                found = integrate(model, p, y, times)
                parts = {"Susceptible": found[:, 0], "Infected": found[:, 1 : 1 + k].sum(axis=1), "Phage": found[:, 1 + k]}
                if last:
                    parts[last] = found[:, 2 + k]
                for name, values in parts.items():
                    yield pd.DataFrame({"run_id": row["run_id"], "t": times, "species": name, "value": values})

    return designs.mapInPandas(run, "run_id long, t double, species string, value double")


def outcomes(trajectories: DataFrame) -> DataFrame:
    """Per run: whether cells collapse (below 1 % of their start) or rebound (above 10 times their least), and phage amplification."""
    s = trajectories.where("species = 'Susceptible'").groupBy("run_id").agg(F.min_by("value", "t").alias("start"), F.max_by("value", "t").alias("end"), F.min("value").alias("least"))
    v = trajectories.where("species = 'Phage'").groupBy("run_id").agg(F.min_by("value", "t").alias("phage_start"), F.max("value").alias("phage_peak"))
    return s.join(v, "run_id").select("run_id", (F.col("least") < 0.01 * F.col("start")).alias("collapse"), ((F.col("end") > 10 * F.col("least")) & (F.col("least") < 0.01 * F.col("start"))).alias("rebound"), (F.col("phage_peak") / F.greatest("phage_start", F.lit(1e-9))).alias("amplification"))


def sweep(spark: SparkSession, parameter: str, model: str = "lytic", n: int = 9, log_scale: bool = True, S0: float = 1e6, P0: float = 1e4, hours: float = 24.0) -> DataFrame:
    """Outcomes over a grid of one parameter's typical range, with the step from the row before."""
    low, high = TYPICAL[parameter]
    low = max(low, 1e-12) if log_scale else low
    grid = np.geomspace(low, high, n) if log_scale else np.linspace(low, high, n)
    designs = spark.createDataFrame([(i, float(v), S0, P0) for i, v in enumerate(grid)], f"run_id long, {parameter} double, S0 double, P0 double").repartition(n)
    found = outcomes(simulate(designs, model, hours, 60)).join(designs.select("run_id", F.col(parameter).alias("setting")), "run_id")
    return found.withColumn("change", F.col("amplification") - F.lag("amplification").over(Window.orderBy("run_id")))  # n rows


def one_step_growth(spark: SparkSession, latent: float = 0.5, burst: float = 100.0, stages: int = 20, adsorption: float = 1e-8, S0: float = 1e8, P0: float = 1e4, hours: float = 3.0) -> DataFrame:
    """Phage curves for 1, 3 and ``stages`` infected stages, and when each first rises above 1.5 times its least value after the dip."""
    runs = [(i, n, latent, burst, adsorption, S0, P0) for i, n in enumerate(sorted({1, 3, stages}))]
    designs = spark.createDataFrame(runs, "run_id long, n_stages int, latent double, burst double, adsorption double, S0 double, P0 double").repartition(len(runs))
    phages = simulate(designs, "lytic", hours, 120).where("species = 'Phage'")
    least = phages.groupBy("run_id").agg(F.min("value").alias("least"), F.min_by("t", "value").alias("dip"))
    rise = phages.join(least, "run_id").where("t > dip and value > 1.5 * least").groupBy("run_id").agg(F.min("t").alias("rise"))
    return designs.select("run_id", "n_stages").join(rise, "run_id", "left")


def gillespie(spark: SparkSession, runs: int = 30, S0: int = 200, P0: int = 5, adsorption: float = 1e-3, burst: int = 50, lysis: float = 2.0, growth: float = 0.5, decay: float = 0.05, t_max: float = 20.0, max_events: int = 400_000, seed: int = 20260901) -> DataFrame:
    """Direct-method runs (adsorption, lysis, growth, decay): final counts, events, and whether phages or cells died out."""

    def run(batches):
        for pdf in batches:
            rows = []
            for i in pdf["id"]:
                rng = np.random.default_rng([seed, int(i)])
                s, infected, v, t, events = S0, 0, P0, 0.0, 0
                while t < t_max and events < max_events:
                    a = (adsorption * s * v, lysis * infected, growth * s, decay * v)
                    total = sum(a)
                    if total <= 0:
                        break
                    t += rng.exponential(1 / total)
                    x = rng.random() * total
                    if x < a[0]:
                        s, v, infected = s - 1, v - 1, infected + 1
                    elif x < a[0] + a[1]:
                        infected, v = infected - 1, v + burst
                    elif x < a[0] + a[1] + a[2]:
                        s += 1
                    else:
                        v -= 1
                    events += 1
                rows.append((int(i), float(min(t, t_max)), s, infected, v, events, v + infected == 0, s + infected == 0))
            yield pd.DataFrame(rows, columns=["run_id", "t", "cells", "infected", "phages", "events", "phages_extinct", "cells_extinct"])

    return spark.range(runs).repartition(min(runs, 64)).mapInPandas(run, "run_id long, t double, cells long, infected long, phages long, events long, phages_extinct boolean, cells_extinct boolean")


def extinction_theory(burst: float, adsorption: float, S0: float, decay: float, P0: int) -> float:
    """q^P0, with q the least root of q = (1 - a) + a q^burst and a the chance to adsorb before decay."""
    a = adsorption * S0 / (adsorption * S0 + decay)
    if a * burst <= 1:
        return 1.0
    q = special.bisect(lambda x: x - (1 - a) - a * x**burst, 0.0, (1 / (a * burst)) ** (1 / (burst - 1)))
    return q**P0


def extinction(spark: SparkSession, P0_values: tuple[int, ...] = (1, 2, 5, 10), runs: int = 60, **p) -> DataFrame:
    """Simulated share of runs that lose their phages for each P0, with Wilson's interval and the branching-process theory."""
    from skerry.operators.lab import wilson

    settings = {"burst": 50, "adsorption": 1e-3, "S0": 200, "decay": 0.05}
    settings |= {k: p.pop(k) for k in list(p) if k in settings}
    parts = None
    for P0 in P0_values:  # a few settings, each of many runs
        found = gillespie(spark, runs, P0=P0, growth=0.0, **settings, **p).agg(F.count("*").alias("runs"), F.count_if(F.col("phages_extinct") & (F.col("cells") > 0)).alias("extinct")).select(F.lit(P0).alias("P0"), "runs", "extinct", F.lit(extinction_theory(P0=P0, **settings)).alias("theory"))
        parts = found if parts is None else parts.unionByName(found)
    low, high = wilson(F.col("extinct"), F.col("runs"))
    return parts.withColumn("low", low).withColumn("high", high)


def poisson_plates(spark: SparkSession, mean: float = 3.0, plates: int = 20, seed: int = 20260901) -> DataFrame:
    """Simulated plaque counts with their probability and exact interval."""

    def run(batches):
        for pdf in batches:
            counts = [int(np.random.default_rng([seed, int(i)]).poisson(mean)) for i in pdf["id"]]
            ends = [special.poisson_interval(c) for c in counts]
            yield pd.DataFrame({"plate": pdf["id"], "plaques": counts, "probability": [special.poisson_pmf(c, mean) for c in counts], "low": [e[0] for e in ends], "high": [e[1] for e in ends]})

    return spark.range(plates).mapInPandas(run, "plate long, plaques long, probability double, low double, high double")


EMPTY, CELL, INFECTED, LYSED, RESISTANT = 0, 1, 2, 3, 4


def plaque(runs: DataFrame, size: int = 101, steps: int = 80, latent: int = 4, spread: float = 0.45, radius: int = 1, resistant: float = 0.0, seed: int = 20260901) -> DataFrame:
    """Plaques on a lattice, one per row (run_id): step, lysed area, mean radius, perimeter and circularity 4 pi A / P^2."""

    def run(batches):
        for pdf in batches:
            for i in pdf["run_id"]:
                rng = np.random.default_rng([seed, int(i)])
                grid = np.where(rng.random((size, size)) < resistant, RESISTANT, CELL)
                timer = np.zeros((size, size), int)
                grid[size // 2, size // 2], timer[size // 2, size // 2] = INFECTED, latent
                rows = []
                for step in range(steps + 1):
                    dead = grid == LYSED
                    area = int(dead.sum())
                    wall = np.pad(dead, 1)
                    perimeter = int(sum((dead & ~np.roll(wall, s, axis)[1:-1, 1:-1]).sum() for axis in (0, 1) for s in (1, -1)))
                    y, x = np.nonzero(dead)
                    rows.append((int(i), step, area, math.sqrt(area / math.pi), perimeter, 4 * math.pi * area / perimeter**2 if perimeter else np.nan))
                    del y, x
                    timer[grid == INFECTED] -= 1
                    burst = (grid == INFECTED) & (timer <= 0)
                    grid[burst] = LYSED
                    reach = np.zeros_like(burst)
                    edge = np.pad(burst, radius)
                    for dy in range(2 * radius + 1):
                        for dx in range(2 * radius + 1):
                            reach |= edge[dy : dy + size, dx : dx + size]
                    new = reach & (grid == CELL) & (rng.random((size, size)) < spread)
                    grid[new], timer[new] = INFECTED, latent
                yield pd.DataFrame(rows, columns=["run_id", "step", "area", "radius", "perimeter", "circularity"])

    return runs.select(F.col("run_id").cast("long")).mapInPandas(run, "run_id long, step int, area long, radius double, perimeter long, circularity double")
