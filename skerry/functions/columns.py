"""Column expressions that many operators share."""

from __future__ import annotations

import inspect
from collections.abc import Sequence
from functools import wraps

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skerry.functions.shared import written

INFINITY = float("inf")


def is_finite(c: Column) -> Column:
    c = c.cast("double")
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(INFINITY))


def finite(df: DataFrame, *columns: str) -> DataFrame:
    """Rows whose ``columns`` are all finite numbers."""
    for c in columns:
        df = df.where(is_finite(F.col(c)))
    return df


def once(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ratio(a: Column, b: Column, otherwise: float | None = None) -> Column:
    """a / b, and ``otherwise`` where b is 0."""
    return F.when(b != 0, a / b).otherwise(F.lit(otherwise).cast("double"))


def draw(*parts: Column | str | int) -> Column:
    """A number of 32 bits drawn from the parts, the same in every engine and on every partitioning."""
    columns = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *(c.cast("string") for c in columns))), 1, 8), 16, 10).cast("long")


def null_safe(pairs: list[tuple[str, str]]) -> Column:
    """Equality of columns of two tables, by which null keys meet too."""
    match = F.lit(True)
    for a, b in pairs:
        match = match & F.col(a).eqNullSafe(F.col(b))
    return match


def meet(a: DataFrame, b: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """A join on equal ``keys`` in which null keys meet; the columns of ``a``, then the others of ``b``.

    Without keys ``b`` is one row, which is sent to all.
    """
    if not keys:
        return a.join(F.broadcast(b), how=how) if how == "inner" else a.join(F.broadcast(b), F.lit(True), how)
    renamed = {k: f"_m_{i}" for i, k in enumerate(keys)}
    return a.join(b.withColumnsRenamed(renamed), null_safe(list(renamed.items())), how).drop(*renamed.values())


def own_names(operator):
    """An operator whose ``by`` columns may have any names, also those of its results or working columns.

    Inside, keys have names of their own.  A result that is called like a key gets an underscore behind its name.
    """
    signature = inspect.signature(operator)

    @wraps(operator)
    def run(*args, **kwargs):
        bound = signature.bind(*args, **kwargs)
        bound.apply_defaults()
        by, first = list(bound.arguments["by"]), next(iter(bound.arguments))
        keys = [f"_key_{i}" for i in range(len(by))]
        bound.arguments[first] = bound.arguments[first].withColumns({k: F.col(c) for c, k in zip(by, keys)})
        bound.arguments["by"] = keys
        found = operator(*bound.args, **bound.kwargs)
        taken, shown = set(by), []
        for c in found.columns:
            if c in keys:
                shown.append(F.col(c).alias(by[keys.index(c)]))
            elif not c.startswith("_key_"):
                shown.append(F.col(c).alias(f"{c}_" if c in taken else c))
        return found.select(*shown)

    return run


def running(df: DataFrame, by: list[str], order: list[str], **columns: tuple[str, Column]) -> DataFrame:
    """``df`` with running values over this row and those before it within ``by``, in order of ``order``.

    A column is ("sum", amount) or ("last", amount), the latest amount that isn't null.  Rows are written in ranges of
    the order, a file each; a file is summed up on its own and what stands in the files before it is added, so that a
    single large ``by`` value uses all tasks, and a range is the same rows however often it is read.  Only the keys at a
    file's ends can have rows in others; these few are summed up and sent to all tasks.  ``order`` must be unique within ``by``; null keys are keys of their own, ``df`` may be empty; names that begin with an underscore and a
    letter are kept for the working columns.
    """
    amounts = {f"_r_{i}": (kind, amount) for i, (kind, amount) in enumerate(columns.values())}
    ranged = written(df.withColumns({k: a for k, (_, a) in amounts.items()}).repartitionByRange(*(by + order)), "ranges").withColumn("_r_file", F.col("_metadata.file_name"))
    total = {"sum": lambda c: F.sum(c), "last": lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(*order)))}
    keys = [(c, f"_r_k{i}") for i, c in enumerate(by)]
    key = F.struct(F.lit(0).alias("_r_all"), *(F.col(c).alias(k) for c, k in keys))
    ends = ranged.groupBy("_r_file").agg(F.min(key).alias("low"), F.max(key).alias("high")).select(F.col("_r_file").alias("_r_f"), F.explode(F.array_distinct(F.array("low", "high"))).alias("_r_key"))
    # at most two rows a file
    shared = ends.withColumn("_r_n", F.count("*").over(Window.partitionBy("_r_key"))).where("_r_n > 1").select("_r_f", "_r_key.*")
    files = ranged.join(F.broadcast(shared), null_safe([*keys, ("_r_file", "_r_f")]), "left_semi").groupBy(*by, "_r_file").agg(F.min(F.struct(*order)).alias("_r_low"), F.max(F.struct(*order)).alias("_r_high"), *(total[kind](k).alias(f"{k}_t") for k, (kind, _) in amounts.items()))
    before = Window.partitionBy(*by).orderBy("_r_low", "_r_high").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*by, "_r_file").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = {"sum": lambda c: F.sum(c).over(before), "last": lambda c: F.last(c, ignorenulls=True).over(before)}
    own = {"sum": lambda c: F.sum(c).over(inside), "last": lambda c: F.last(c, ignorenulls=True).over(inside)}
    offsets = files.select(*(F.col(c).alias(k) for c, k in keys), F.col("_r_file").alias("_r_f"), *(ahead[kind](f"{k}_t").alias(f"{k}_b") for k, (kind, _) in amounts.items()))
    joined = ranged.withColumns({f"{k}_o": own[kind](k) for k, (kind, _) in amounts.items()}).join(F.broadcast(offsets), null_safe([*keys, ("_r_file", "_r_f")]), "left")
    whole = {"sum": lambda k: F.when(F.col(f"{k}_o").isNull(), F.col(f"{k}_b")).otherwise(F.col(f"{k}_o") + F.coalesce(F.col(f"{k}_b"), F.lit(0))), "last": lambda k: F.coalesce(F.col(f"{k}_o"), F.col(f"{k}_b"))}
    return joined.select(*df.columns, *(whole[kind](k).alias(to) for to, (k, (kind, _)) in zip(columns, amounts.items())))


def running_sum(df: DataFrame, by: list[str], order: list[str], amount: str, to: str) -> DataFrame:
    """``df`` with the sum of ``amount`` over this row and those before it, as ``running`` finds it."""
    return running(df, by, order, **{to: ("sum", F.col(amount))})


def as_of(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, order: Sequence[str] = (), own: dict[str, tuple[str, Column]] | None = None, **columns: tuple[str, str]) -> DataFrame:
    """``left`` with the latest values of ``right`` at or before its time: each column is ("last", name) or ("sum", name) of ``right``.

    Both sides stand in one order of time, so that nothing is joined and a hot key is spread over tasks.  Rows without
    an earlier right row, or with a null time, get nulls; rows of one time count as at that time; null keys meet.
    ``own`` are running values of ``left`` itself, as of ``running``, in order of its time and then of its columns ``order``.
    """
    own, tie = own or {}, [f"_a_o{i}" for i in range(len(order))]
    keys = [f"_a_{i}" for i in range(len(by))]
    row = F.struct(*left.columns)
    blank = [F.lit(None).cast(right.schema[c].dataType).alias(to) for to, (_, c) in columns.items()]
    ours = left.select(*(F.col(c).alias(k) for c, k in zip(by, keys)), F.col(left_time).alias("_a_t"), F.lit(1).alias("_a_s"), *(F.col(c).alias(o) for c, o in zip(order, tie)), F.monotonically_increasing_id().alias("_a_i"), row.alias("_a_row"), *blank, *(amount.alias(f"_a_own_{to}") for to, (_, amount) in own.items()))
    theirs = right.where(F.col(right_time).isNotNull()).select(*(F.col(c).alias(k) for c, k in zip(by, keys)), F.col(right_time).alias("_a_t"), F.lit(0).alias("_a_s"), *(F.lit(None).cast(ours.schema[o].dataType).alias(o) for o in tie), F.monotonically_increasing_id().alias("_a_i"), F.lit(None).cast(ours.schema["_a_row"].dataType).alias("_a_row"), *(F.col(c).alias(to) for to, (_, c) in columns.items()), *(F.lit(None).cast(ours.schema[f"_a_own_{to}"].dataType).alias(f"_a_own_{to}") for to in own))
    found = running(ours.unionByName(theirs), keys, ["_a_t", "_a_s", *tie, "_a_i"], **{f"_a_{to}": (kind, F.col(to)) for to, (kind, _) in columns.items()}, **{f"_a_{to}": (kind, F.col(f"_a_own_{to}")) for to, (kind, _) in own.items()})
    return found.where("_a_s = 1").select("_a_row.*", *(F.col(f"_a_{to}").alias(to) for to in [*own, *columns]))
