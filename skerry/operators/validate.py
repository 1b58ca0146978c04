"""Table validation: all cells as text, unpivoted to (row_num, column_name, raw), rules as projections.

Defined cases: null cells are missing; a table without rows has too few; equal rows are reported from the second on, with
null cells equal to each other; columns may have any names; rules for columns that are not there are reported once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Marks of a missing cell, the form of a number, the columns of the table templates.
MISSING = ("", "na", "n/a", "nan", "none", "null", "-", "--", "?", "nd", "n.d.")
NUMBER = r"^\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*$"
NONE = float("nan")


@dataclass(frozen=True)
class Rule:
    """One column of a template."""

    name: str
    kind: str = "number"
    required: bool = True
    least: float | None = None
    most: float | None = None
    allowed: tuple[str, ...] | None = None


TEMPLATES: dict[str, tuple[list[Rule], int]] = {
    "serial_dilution": ([Rule("tube", "integer", least=0), Rule("dilution_factor", least=1), Rule("count", "integer", False, 0), Rule("volume_plated_mL", "number", False, 1e-6, 10)], 3),
    "water_quality": ([Rule("sample", "text"), Rule("pH", "number", False, 0, 14), Rule("nitrate_ppm", "number", False, 0), Rule("hardness_ppm", "number", False, 0), Rule("chlorine_ppm", "number", False, 0)], 3),
    "growth_vs_factor": ([Rule("level", "text"), Rule("replicate", "integer", False, 1), Rule("measurement"), Rule("units", "text", False)], 3),
    "daily_readings": ([Rule("day", least=0), Rule("reading"), Rule("group", "text", False), Rule("notes", "text", False)], 4),
    "plaque_assay": ([Rule("sample", "text"), Rule("dilution_factor", least=1), Rule("plaque_count", "integer", least=0), Rule("volume_plated_mL", "number", False, 1e-6, 10), Rule("plaque_morphology", "text", False)], 3),
    "site_survey": ([Rule("site_id", "text"), Rule("latitude", "number", False, -90, 90), Rule("longitude", "number", False, -180, 180), Rule("habitat", "text", False), Rule("soil_pH", "number", False, 0, 14), Rule("moisture_percent", "number", False, 0, 100)], 3),
    "community_counts": ([Rule("sample", "text"), Rule("taxon", "text"), Rule("count", "integer", least=0)], 3),
}


def is_missing(raw: Column) -> Column:
    return raw.isNull() | F.lower(F.trim(raw)).isin(*MISSING)


def as_number(raw: Column) -> Column:
    """The number in a cell, units and thousands commas aside; null if there is none."""
    digits = F.regexp_replace(raw, "[^0-9.eE+-]", "")
    return F.when(digits.rlike(NUMBER), F.try_cast(digits, "double") if hasattr(F, "try_cast") else digits.try_cast("double"))


def cells(df: DataFrame, key: str) -> DataFrame:
    """(row_num, column_name, raw): ``key`` must be a dense row number from 0; row numbers in reports count the header and start at 2."""
    others = [c for c in df.columns if c != key]
    pairs = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("raw")) for c in others))
    return df.select((F.col(key) + 2).cast("long").alias("row_num"), F.explode(pairs).alias("x")).select("row_num", "x.*")


#: Shares of numbers between which a column is taken for one of numbers with some text in it; cells of it that are shown.
MIXED, SHOWN = 0.7, 5


def mixed(df: DataFrame, key: str) -> DataFrame:
    """Issues of a table without rules: the first cells of text in a column that is mostly numbers."""
    c = cells(df, key).where(~is_missing(F.col("raw"))).withColumn("odd", as_number(F.col("raw")).isNull())
    share = c.groupBy("column_name").agg(F.avg((~F.col("odd")).cast("double")).alias("share")).where((F.col("share") > MIXED) & (F.col("share") < 1))
    # only the first rows of each column are ranked, so a window of a column gets few
    w = Window.partitionBy("column_name").orderBy("row_num")
    odd = c.where("odd").join(F.broadcast(share), "column_name").withColumn("place", F.row_number().over(w)).where(F.col("place") <= SHOWN)  # one row a column
    hint = F.format_string("%.0f %% of this column are numbers", F.col("share") * 100)
    return odd.select(F.lit("block").alias("severity"), "row_num", "column_name", F.lit("not_a_number").alias("rule"), hint.alias("hint"))


def validate(df: DataFrame, key: str, rules: list[Rule] | None = None, least_rows: int = 3) -> DataFrame:
    """Issues (severity, row_num, column_name, rule, hint): block, warn or info.  The table is valid without a block.

    Without rules, columns of mostly numbers are expected to hold numbers.  A missing column's hint is the name that is
    nearest to it among those that the rules don't know; a number out of range has the limit.
    """
    if rules is None:
        rows = mixed(df, key)
        return rows.unionByName(_whole_table(df, key, least_rows))
    spark = df.sparkSession
    schema = "column_name string, kind string, required boolean, least double, most double, allowed array<string>"
    known = spark.createDataFrame([(r.name, r.kind, r.required, *(None if x is None else float(x) for x in (r.least, r.most)), list(r.allowed) if r.allowed else None) for r in rules], schema)
    c = cells(df, key).join(F.broadcast(known), "column_name").withColumn("value", as_number(F.col("raw"))).withColumn("missing", is_missing(F.col("raw")))
    numeric, v = F.col("kind").isin("number", "integer"), F.col("value")
    found = [
        (F.col("missing") & F.col("required"), "warn", "missing_value"),
        (~F.col("missing") & numeric & v.isNull(), "block", "not_a_number"),
        ((F.col("kind") == "integer") & (F.abs(v - F.round(v)) > 1e-9), "warn", "not_whole"),
        (numeric & (v < F.col("least")), "block", "below_minimum"),
        (numeric & (v > F.col("most")), "block", "above_maximum"),
        (~F.col("missing") & F.col("allowed").isNotNull() & ~F.array_contains("allowed", F.trim("raw")), "warn", "not_allowed"),
    ]
    hints = {"below_minimum": F.concat(F.lit("at least "), F.col("least").cast("string")), "above_maximum": F.concat(F.lit("at most "), F.col("most").cast("string")), "not_allowed": F.concat(F.lit("one of "), F.array_join("allowed", ", "))}
    shown = lambda name: hints.get(name, F.lit(None).cast("string")).alias("hint")
    issues = F.filter(F.array(*(F.when(F.coalesce(test & ~(F.col("missing") & F.lit(name != "missing_value")), F.lit(False)), F.struct(F.lit(s).alias("severity"), F.lit(name).alias("rule"), shown(name))) for test, s, name in found)), lambda x: x.isNotNull())
    rows = c.select("row_num", "column_name", F.explode(issues).alias("x")).select("x.severity", "row_num", "column_name", "x.rule", "x.hint")
    none = F.lit(None).cast("long")
    there = [x for x in df.columns if x != key]
    lacking, extra = [r.name for r in rules if r.required and r.name not in there], [x for x in there if x not in {r.name for r in rules}]
    whole = [("block", x, "missing_column") for x in lacking] + [("info", x, "extra_column") for x in extra]
    if whole:
        named = spark.createDataFrame(whole, "severity string, column_name string, rule string")
        named = closest(named, "column_name", extra, "near") if extra else named.withColumn("near", F.lit(None).cast("string"))
        hint = F.when((F.col("rule") == "missing_column") & F.col("near").isNotNull(), F.concat(F.lit("is it "), F.col("near"), F.lit("?")))
        rows = rows.unionByName(named.select("severity", none.alias("row_num"), "column_name", "rule", hint.alias("hint")))
    return rows.unionByName(_whole_table(df, key, least_rows))


def _whole_table(df: DataFrame, key: str, least_rows: int) -> DataFrame:
    """Issues of rows and not of cells."""
    none, no_column = F.lit(None).cast("long"), F.lit(None).cast("string")
    few = df.agg(F.count("*").alias("n")).where(F.col("n") < least_rows).select(F.lit("warn").alias("severity"), none.alias("row_num"), no_column.alias("column_name"), F.lit("too_few_rows").alias("rule"), F.concat(F.lit("at least "), F.lit(str(least_rows))).alias("hint"))
    again = F.concat(F.lit("as in row "), F.col("first_row").cast("string"))
    return few.unionByName(duplicates(df, key).select(F.lit("warn").alias("severity"), "row_num", no_column.alias("column_name"), F.lit("duplicate_row").alias("rule"), again.alias("hint")))


def duplicates(df: DataFrame, key: str) -> DataFrame:
    """Rows equal to an earlier one in all other columns: row_num and first_row."""
    content = F.to_json(F.struct(*(F.col(c).cast("string").alias(c) for c in df.columns if c != key)), {"ignoreNullFields": "false"})
    rows = df.select((F.col(key) + 2).cast("long").alias("row_num"), F.sha2(content, 256).alias("content"))
    first = rows.groupBy("content").agg(F.min("row_num").alias("first_row"), F.count("*").alias("n")).where("n > 1")
    return rows.join(first, "content").where("row_num > first_row").select("row_num", "first_row")


def closest(names: DataFrame, name: str, candidates: list[str], to: str = "closest") -> DataFrame:
    """The candidate of least case-insensitive edit distance (first of equals), if at most max(2, a third of the name)."""
    ranked = F.array_min(F.array(*(F.struct(F.levenshtein(F.lower(name), F.lit(c.lower())).alias("d"), F.lit(i).alias("i"), F.lit(c).alias("c")) for i, c in enumerate(candidates))))
    limit = F.greatest(F.lit(2), F.floor(F.length(name) / 3))
    return names.withColumn(to, F.when(ranked["d"] <= limit, ranked["c"]))


MOST_ALLOWED = 12


def infer(df: DataFrame, key: str) -> DataFrame:
    """Per column: kind (integer, number, category or text), observed range, distinct values, cells missing, and the values that a category of at most 12 allows."""
    c = cells(df, key).withColumn("raw", F.trim("raw")).withColumn("missing", is_missing(F.col("raw")))
    c = c.withColumn("value", F.when(~F.col("missing"), as_number(F.col("raw"))))
    per = c.groupBy("column_name", F.when(~F.col("missing"), F.col("raw")).alias("v")).agg(F.count("*").alias("n"), F.max("value").alias("value"))
    s = per.groupBy("column_name").agg(
        F.sum("n").alias("rows"), F.sum(F.when(F.col("v").isNotNull(), F.col("n")).otherwise(0)).alias("present"), F.sum(F.when(F.col("value").isNotNull(), F.col("n")).otherwise(0)).alias("numeric"),
        F.sum(F.when(F.abs(F.col("value") - F.round("value")) <= 1e-9, F.col("n")).otherwise(0)).alias("whole"), F.min("value").alias("minimum"), F.max("value").alias("maximum"), F.count("v").alias("n_distinct"),
    )
    # the values of columns that have few
    few = per.join(s.where(F.col("n_distinct") <= MOST_ALLOWED).select("column_name"), "column_name", "left_semi")
    s = s.join(few.groupBy("column_name").agg(F.array_sort(F.collect_set("v")).alias("_values")), "column_name", "left")
    numeric = (F.col("present") > 0) & (F.col("numeric") == F.col("present"))
    category = F.col("n_distinct") <= F.greatest(F.lit(2), F.floor(F.col("rows") / 3))
    kind = F.when(numeric & (F.col("whole") == F.col("present")), "integer").when(numeric, "number").when(category, "category").otherwise("text")
    return s.select("column_name", kind.alias("kind"), F.when(numeric, F.col("minimum")).alias("minimum"), F.when(numeric, F.col("maximum")).alias("maximum"), "n_distinct", (F.col("rows") - F.col("present")).alias("missing"), F.when(kind == "category", F.col("_values")).alias("allowed"))


def suggest_template(columns: list[str]) -> str | None:
    """The template that shares most column names, from 2 on; the first of equals."""
    best = max(TEMPLATES, key=lambda k: len({r.name for r in TEMPLATES[k][0]} & {*columns}))
    return best if len({r.name for r in TEMPLATES[best][0]} & {*columns}) >= 2 else None


def coerce(df: DataFrame, numeric: list[str]) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped): numeric columns as doubles, missing cells null; rows with an unreadable number are dropped, never guessed."""
    bad = F.lit(False)
    for c in numeric:
        raw = F.col(c).cast("string")
        bad = bad | (~is_missing(raw) & as_number(raw).isNull())
    kept = df.where(~bad)
    for c in numeric:
        raw = F.col(c).cast("string")
        kept = kept.withColumn(c, F.when(~is_missing(raw), as_number(raw)))
    return kept, df.where(bad)
