"""Typed tools: which operator runs under a name, for which grades, with which arguments.

Unlike a signature that is only listed, a tool's declared arguments are exactly those that its call
accepts, and every inferential tool takes a justification.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from skerry.operators import curves, diversity, groups, lab, neighbours, resample, sequences, series, simulate, validate
from skerry.plans import compare
from skerry.plans.compare import compare_groups


@dataclass(frozen=True)
class Tool:
    name: str
    category: str
    low: int
    high: int
    call: Callable
    required: tuple[str, ...]
    optional: tuple[str, ...] = ()
    inferential: bool = False


TOOLS = {
    t.name: t
    for t in (
        Tool("describe", "statistics", 5, 12, groups.describe, ("df", "group", "value"), ("by",)),
        Tool("compare_groups", "statistics", 7, 12, compare_groups, ("df", "group", "value"), ("by", "alpha", "prefer_robust"), True),
        Tool("shuffle_test", "statistics", 7, 12, resample.shuffle_test, ("rows", "group", "value", "a", "b", "replicates"), ("seed", "name"), True),
        Tool("correlate", "statistics", 8, 12, compare.correlate, ("df", "x", "y"), ("alpha",), True),
        Tool("contingency", "statistics", 8, 12, compare.contingency_test, ("df", "row", "column"), (), True),
        Tool("trend_test", "statistics", 9, 12, compare.trend_test, ("df", "order", "value", "by"), ("alpha",), True),
        Tool("bootstrap_ci", "statistics", 6, 12, resample.bootstrap, ("rows", "value", "replicates"), ("name", "seed")),
        Tool("jackknife", "statistics", 8, 12, resample.jackknife, ("rows", "value"), ("name",)),
        Tool("fit_curve", "statistics", 8, 12, curves.fit, ("df", "series", "x", "y", "models")),
        Tool("compare_models", "statistics", 9, 12, curves.compare_models, ("df", "series", "x", "y", "models")),
        Tool("fit_growth_curve", "statistics", 9, 12, series.growth, ("df", "time", "density", "by")),
        Tool("alpha_diversity", "diversity", 9, 12, diversity.alpha, ("counts",)),
        Tool("compare_composition", "diversity", 9, 12, compare.compare_composition, ("counts", "labels"), ("metric", "replicates"), True),
        Tool("rarefaction_curve", "diversity", 9, 12, diversity.rarefaction, ("counts",), ("points",)),
        Tool("dilution_series", "lab", 5, 12, lab.dilution_series, ("spark",), ("start", "fold", "steps", "transferred", "diluent")),
        Tool("pfu_per_ml", "lab", 8, 12, lab.titre, ("df", "count", "dilution", "volume")),
        Tool("titre_from_plates", "lab", 9, 12, lab.pooled_titre, ("df", "count", "dilution", "volume", "by"), (), True),
        Tool("moi", "lab", 8, 12, lab.infection, ("df", "phage", "bacteria")),
        Tool("simulate", "simulation", 8, 12, simulate.simulate, ("designs",), ("model", "hours", "points")),
        Tool("parameter_sweep", "simulation", 8, 12, simulate.sweep, ("spark", "parameter"), ("model", "n", "log_scale", "S0", "P0", "hours")),
        Tool("one_step_growth", "simulation", 9, 12, simulate.one_step_growth, ("spark",), ("latent", "burst", "stages", "adsorption", "S0", "P0", "hours")),
        Tool("gillespie_lytic", "simulation", 9, 12, simulate.gillespie, ("spark",), ("runs", "S0", "P0", "adsorption", "burst", "lysis", "growth", "decay", "t_max", "max_events", "seed")),
        Tool("poisson_plaques", "simulation", 8, 12, simulate.poisson_plates, ("spark",), ("mean", "plates", "seed")),
        Tool("plaque_growth", "simulation", 8, 12, simulate.plaque, ("runs",), ("size", "steps", "latent", "spread", "radius", "resistant", "seed")),
        Tool("translate", "sequence", 9, 12, sequences.translate, ("df", "sequence"), ("frame", "to_stop", "to")),
        Tool("gc_content", "sequence", 6, 12, sequences.gc, ("df", "sequence")),
        Tool("find_orfs", "sequence", 9, 12, sequences.orfs, ("df", "sequence", "key"), ("least",)),
        Tool("codon_usage", "sequence", 11, 12, sequences.codon_usage, ("df", "sequence", "by"), ("frame",)),
        Tool("tetranucleotide_vector", "geometry", 7, 12, sequences.kmers, ("df", "sequence", "by"), ("k", "canonical")),
        Tool("component_sweep", "geometry", 9, 12, neighbours.component_sweep, ("pairs",), ("k_min", "k_max", "mutual")),
        Tool("bridge_analysis", "geometry", 11, 12, neighbours.bridges, ("pairs", "clades"), ("k_min", "k_max", "alpha"), True),
        Tool("validate_table", "data", 5, 12, validate.validate, ("df", "key", "rules"), ("least_rows",)),
        Tool("infer_schema", "data", 5, 12, validate.infer, ("df", "key")),
    )
}


def tools_for(grade: int) -> list[Tool]:
    return sorted((t for t in TOOLS.values() if t.low <= grade <= t.high), key=lambda t: (t.category, t.name))


def call(name: str, grade: int = 12, justification: str = "", **arguments):
    """Run a tool; refusals are ValueErrors that say what is wrong."""
    tool = TOOLS.get(name)
    if tool is None:
        raise ValueError(f"no tool is called {name!r}")
    if not tool.low <= grade <= tool.high:
        raise ValueError(f"{name} is for grades {tool.low} to {tool.high}")
    if tool.inferential and not justification.strip():
        raise ValueError(f"{name} needs a justification")
    if missing := [a for a in tool.required if a not in arguments]:
        raise ValueError(f"{name} lacks {', '.join(missing)}")
    if unknown := [a for a in arguments if a not in tool.required + tool.optional]:
        raise ValueError(f"{name} doesn't know {', '.join(unknown)}")
    return tool.call(**arguments)
