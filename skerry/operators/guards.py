"""Text guards: redaction, blocked claims, search for a wished-for result, package names, unverified numbers.

Claims and searches are phrases: sets of words in a fixed order within one sentence, with at most so many other words
between one set and the next.  A negation between them ("does not prove") breaks the phrase.  A text is brought to one
form once, its sentences and words apart, and every phrase is looked for in that form.  Numbers are found by one form
of a number; what it is called by, the label before it, says what kind of claim it makes.

Defined cases: a null text has no claims, packages or numbers and stays null when redacted; an empty table has no rows;
repeated rows are judged alike, null keys are kept; time is linear in the length of a text, also of a single word.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.functions.columns import once

#: Personal data in the order in which it is replaced: an address (of at most 64 and 255 characters), a pair of precise
#: coordinates, an identity number of three groups of four, a mobile number of ten digits with or without its country code.
PERSONAL = [
    (r"[^\s@<>,;:()]{1,64}@[^\s@<>,;:()]{0,254}[A-Za-z0-9]", "[EMAIL]"),
    (r"[-+]?[0-9]{1,3}\.[0-9]{4,}\s*[,;]\s*[-+]?[0-9]{1,3}\.[0-9]{4,}", "[COORDS]"),
    (r"\b[0-9]{4}(?:[ -]?[0-9]{4}){2}\b", "[ID]"),
    (r"(?:(?:\+|\b00)91[ .-]?)?\b[6-9](?:[ -]?[0-9]){9}\b", "[PHONE]"),
]
#: Between sentences, and in place of a negation, stands a mark that no phrase passes.
SENTENCE_END, BREAK, NEGATION = r"[.!?;]+(?:\s|$)|\n", "\u00b6", "\u00ac"
NOT_A_WORD = rf"[^a-z0-9.'{BREAK}-]+"
NEGATIONS = r" (?:not|never|cannot|neither|hardly|[a-z]+n't) "


def phrase(*parts: str | int) -> str:
    """A pattern for word sets ("one/other/stem*", ``#`` for a whole number) with at most so many words between them.

    Sets that follow each other without a number stand side by side.
    """
    pattern, gap = "", ""
    for part in parts:
        if isinstance(part, int):
            gap = f"(?:[^ {BREAK}{NEGATION}]+ ){{0,{part}}}"
            continue
        words = "|".join(re.escape(w[:-1]) + "[^ ]*" if w.endswith("*") else "[0-9]+" if w == "#" else re.escape(w) for w in part.split("/"))
        pattern, gap = f"{pattern}{gap}(?:{words}) " if pattern else f" (?:{words}) ", ""
    return pattern


_EMBEDDED, _APART = "umap/tsne/t-sne/pacmap/embedding", "far/farther/further/apart/distant/distance/distances/close/closer/nearer/tightly/separated/gap"
_PROVE, _SHOW = "prove/proves/proved/proving/proof/confirm/confirms/confirmed/establish/establishes", "show/shows/showed/mean/means/demonstrate/demonstrates/imply/implies/reveal/reveals/tell/tells"
_UNDECIDED = "p/p-value/significant/non-significant/nonsignificant/insignificant/significance"
_KINDS = "kind/kinds/type/types/species/group/groups/population/populations/family/families/strain/strains"
#: Phrases of claims that no method supports.
CLAIMS = {
    "umap_distance": [phrase(_EMBEDDED, 12, _APART), phrase(_APART, 8, _EMBEDDED)],
    "causation": [phrase("correlate*/correlation*/associated/association*", 12, "cause/causes/caused/causing/therefore/hence/thus/drives/proves/proof")],
    "accepting_null": [
        phrase(_UNDECIDED, 8, f"{_PROVE}/{_SHOW}", 5, "no/zero", 2, "difference*/effect*/change*/influence/relation*/link"),
        phrase(_UNDECIDED, 8, f"{_PROVE}/{_SHOW}", 6, "are/is/were/was", 1, "same/identical/equal/equivalent/alike"),
        phrase(_UNDECIDED, 8, "so/therefore/hence/thus", 5, "are/is/were/was", 1, "same/identical/equal/equivalent/alike"),
    ],
    "cluster_reification": [
        phrase("cluster*/k-means/kmeans", 8, _PROVE, 6, f"real/true/genuine/exactly/{_KINDS}"),
        phrase("cluster*/k-means/kmeans", 8, _SHOW, 5, "real/true/genuine/exactly/#", 2, _KINDS),
        phrase("cluster*/k-means/kmeans", 10, "so/therefore/hence/thus", 4, "different/separate/distinct/real/true", 1, _KINDS),
    ],
}
_MEASURED = "outlier*/point/points/value/values/row/rows/reading/readings/sample/samples/measurement*/tube/tubes/replicate*/plate/plates/datum"
_ANALYSIS = "test/tests/grouping/groupings/method/methods/model/models/cutoff/cut-off/threshold/analysis/analyses/specification*/subset/subsets/way"
_OUTCOME = "works/work/significant/passes/agrees/fits/matches"
#: Phrases of a search for the specification that gives the wished-for result.
SEARCHING = [
    [phrase("try/trying/use/using/run/running/pick/switch", 3, "different/another/other", 2, _ANALYSIS)],
    [phrase("drop/dropping/remove/removing/exclude/excluding/delete/deleting/ignore/ignoring/discard/omit", 3, _MEASURED), phrase("leave/leaving/take/taking/throw", 1, "out/away", 3, _MEASURED), phrase("leave/leaving/take/taking/throw", 3, _MEASURED, "out/away")],
    [phrase("what", "if", "we/i/you", 1, "exclude*/drop*/remove*/ignore*/leave/left/delete*/omit*")],
    [phrase("until", 3, _OUTCOME)],
    [phrase("without/minus", 1, "outlier*/weird/odd/strange/bad/annoying")],
    [phrase("regroup*/re-group*/rebin*/re-bin*/reclassif*/relabel*")],
    [phrase("make/making/get/getting/push/pushing/bring/bringing", 1, "it/this/that/p/result/difference/effect", 2, "significant/significance"), phrase("get/getting/push/pushing/bring/bringing", 3, "under/below", 1, "0.05/.05/05/5")],
    [phrase("p-hack*/phack*"), phrase("p", "hack*")],
    [phrase("uncertainty", 2, "across", 3, "specification*")],
    [phrase("robust/robustness", 2, "across", 3, "specification*")],
]
# Package names that install something else, and licences that a closed core can't link.
NAME_TRAPS = ("drc", "jellyfish", "wish", "basico", "graph-tool", "community", "ete3", "dspy-ai", "python-igraph", "tetranucleotide", "tnf", "phage-dynamics")
COPYLEFT = {
    "pingouin": "GPL-3", "leidenalg": "GPL-3", "amiga": "GPL-3", "igraph": "GPL-2", "python-igraph": "GPL-2", "phate": "GPL-2", "vegan": "GPL-2",
    "growthcurver": "GPL-2", "giotto-tda": "AGPL-3", "phyloseq": "AGPL-3", "jamovi": "AGPL-3", "jasp": "AGPL-3", "graph-tool": "LGPL-3",
}
INSTALLERS, ASKED = ("pip", "pip3", "conda", "mamba", "micromamba", "uv"), ("install", "add")
# Least sample sizes of kinds of analysis.
FLOORS = {"machine_learning": 100, "supervised": 100, "clustering": 50, "dimensionality_reduction": 30, "umap": 50, "correlation": 8, "inference": 3, "descriptive": 1}
# The labels before a number by which a statistic is known, without case; numbers of the last kind are settings, not results.
LABELS = {
    "p_value": ("p",),
    "test_statistic": ("t", "f", "z", "h", "u", "w"),
    "chi_square": ("chi2", "chi-squared", "χ²", "χ2"),
    "effect_size": ("d", "g", "eta2", "η²", "r", "rho", "ρ", "tau", "τ", "v"),
    "interval": ("ci", "interval"),
    "setting": ("k", "n", "alpha"),
}
# Words before a number that names something and claims nothing.
NAMED = ("grade", "class", "year", "step", "stage", "tube", "plate", "day", "week", "page", "figure", "table", "section", "question", "part", "version", "python", "scipy", "numpy", "level", "row")
_KIND = {label: kind for kind, labels in LABELS.items() for label in labels}
_NUMBER = re.compile(r"(?<![\w.])[-+]?(?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)?(?:\.[0-9]+|(?<=[0-9]))(?:[eE][-+]?[0-9]+)?(?!\w)")
_LABEL = re.compile(r"([^\W\d_][\w²-]*)\s*(?:\([^()]*\))?\s*(?:[=<>:]|\[)\s*\[?\s*$")
_FREEDOM = re.compile(r"\b([^\W\d_]+)\s*\(\s*(?:[0-9.]+\s*,\s*)*$")
_WORD = re.compile(r"([^\W\d_]+)[\s:#]*$")


def redact(text: Column, names: tuple[str, ...] = ()) -> Column:
    """Personal data replaced by tags, then the given names (of more than 2 letters, as whole words)."""
    for pattern, tag in PERSONAL:
        text = F.regexp_replace(text, pattern, tag)
    for name in names:
        if len(name) > 2:
            text = F.regexp_replace(text, rf"(?i)\b{re.escape(name)}\b", "[STUDENT]")
    return text


def personal_tags(text: Column) -> Column:
    return F.array_compact(F.array(*(F.when(text.rlike(p), F.lit(t)) for p, t in PERSONAL)))


def spoken(text: Column) -> Column:
    """One form of a text for phrases: lower-case words with a space around each, marks between sentences and for negations."""
    text = F.regexp_replace(F.lower(text), SENTENCE_END, f" {BREAK} ")
    return F.regexp_replace(F.concat(F.lit(" "), F.regexp_replace(text, NOT_A_WORD, " "), F.lit(" ")), NEGATIONS, f" {NEGATION} ")


def _said(form: Column, phrases: list[str]) -> Column:
    found = F.lit(False)
    for p in phrases:
        found = found | form.rlike(p)
    return found


def blocked_claims(text: Column) -> Column:
    """The kinds of unsupported claims in a text."""
    return once(F.coalesce(spoken(text), F.lit("")), lambda t: F.array_compact(F.array(*(F.when(_said(t, phrases), F.lit(k)) for k, phrases in CLAIMS.items()))))


def searching(text: Column) -> Column:
    """Numbers (from 1) of the wordings that search for a wished-for result."""
    return once(F.coalesce(spoken(text), F.lit("")), lambda t: F.array_compact(F.array(*(F.when(_said(t, phrases), F.lit(i)) for i, phrases in enumerate(SEARCHING, 1)))))


def packages(text: Column) -> Column:
    """Lower-cased names of packages that a text installs or imports, line by line."""
    def of_line(line: Column) -> Column:
        words = F.split(F.trim(F.lower(line)), r"\s+")
        asked = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.get(words, i).isin(*ASKED) & F.coalesce(F.get(words, i - 1).isin(*INSTALLERS), F.lit(False)))
        after = F.slice(words, F.coalesce(F.get(asked, F.lit(0)) + 2, F.size(words) + 1), F.size(words))
        named = F.transform(F.filter(after, lambda w: ~w.startswith("-")), lambda w: F.regexp_extract(w, r"^[a-z0-9._-]*", 0))
        loaded = F.when(F.get(words, F.lit(0)).isin("import", "from"), F.array(F.regexp_extract(F.coalesce(F.get(words, F.lit(1)), F.lit("")), r"^\w*", 0))).otherwise(F.array().cast("array<string>"))
        return F.filter(F.concat(named, loaded), lambda w: w != "")

    return F.array_sort(F.array_distinct(F.flatten(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), of_line))))


def package_issues(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, package, issue) for names that install something else or carry a copyleft licence."""
    spark = df.sparkSession
    known = spark.createDataFrame([(n, "name") for n in NAME_TRAPS] + list(COPYLEFT.items()), "package string, issue string")
    return df.select(key, F.explode(packages(F.col(text))).alias("package")).join(F.broadcast(known), "package").select(key, "package", "issue")


def sample_size(n: Column, task: str, features: Column | None = None) -> Column:
    """Whether an analysis of this kind is allowed: n reaches the floor, and there are fewer features than rows."""
    allowed = n >= FLOORS.get(task, 100)
    return allowed if features is None else allowed & (features < n)


def claims_of(text: str) -> list[tuple[int, int, str, float, int]]:
    """Number claims of a text: start, end, kind, number and its written decimals.

    Settings, small whole numbers, and whole or decimal numbers behind a word that they name are no claims.
    """
    found = []
    for m in _NUMBER.finditer(text):
        token, before = m.group().replace(",", ""), text[: m.start()]
        if not any(c.isdigit() for c in token):
            continue
        number, end = float(token), m.end()
        label = _LABEL.search(before) or _FREEDOM.search(before)
        kind = _KIND.get(label.group(1).lower()) if label else None
        percent = re.match(r"\s*%", text[end:])
        places = 6 if "e" in token.lower() else len(token.partition(".")[2])
        if kind == "setting":
            continue
        if kind is None:
            kind = "percentage" if percent else "scientific" if "e" in token.lower() else "decimal" if "." in token else "integer"
            word = _WORD.search(before)
            if (word and word.group(1).lower() in NAMED) or (kind == "integer" and abs(number) < 10):
                continue
        found.append((m.start(), end + (percent.end() if percent else 0), kind, number, places))
    return found


def number_claims(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, start, end, kind, number, places) of every number that a text claims; the extraction runs in Arrow batches."""

    @F.pandas_udf("array<struct<start:int,end:int,kind:string,number:double,places:int>>")
    def extract(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [dict(zip(("start", "end", "kind", "number", "places"), c)) for c in claims_of(t or "")])

    return df.select(F.col(key), F.explode(extract(text)).alias("c")).select(key, "c.*")


def scan_numbers(df: DataFrame, key: str, text: str, known: DataFrame, tolerance: float = 1e-6, allowed: tuple[float, ...] = ()) -> DataFrame:
    """Unverified numbers (key, start, end, kind, number): those that no value of ``known`` (key, value), and none of ``allowed``, matches.

    A number matches within half a unit of its last written decimal, also as a hundredth (percent).  The
    match is a join on the key with a range condition.
    """
    claims = number_claims(df, key, text)
    half = 0.5 * F.pow(F.lit(10.0), -F.col("places")) + tolerance
    close = lambda v: (F.abs(v - F.col("number")) <= half) | ((F.col("kind") == "percentage") & (F.abs(v * 100 - F.col("number")) <= half))
    for value in allowed:
        claims = claims.where(~close(F.lit(float(value))))
    values = known.select(F.col(key).alias("_key"), "value")
    return claims.join(values, (F.col(key) == F.col("_key")) & close(F.col("value")), "left_anti").select(key, "start", "end", "kind", "number")


def redact_numbers(df: DataFrame, key: str, text: str, known: DataFrame, tolerance: float = 1e-6, allowed: tuple[float, ...] = ()) -> DataFrame:
    """Per row of a unique ``key``: the text with [UNVERIFIED] for its unverified numbers, how many, and a message that masks their digits."""
    found = scan_numbers(df, key, text, known, tolerance, allowed).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("start", "end")), False).alias("_spans"))
    cut = lambda t, s: F.concat(t.substr(F.lit(1), s["start"]), F.lit("[UNVERIFIED]"), t.substr(s["end"] + 1, F.length(t)))
    rows = df.join(found.withColumnRenamed(key, "_key"), F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")
    n = F.coalesce(F.size("_spans"), F.lit(0))
    shown = F.transform(F.reverse("_spans"), lambda s: F.regexp_replace(F.col(text).substr(s["start"] + 1, s["end"] - s["start"]), "[0-9]", "#"))
    message = F.when(n > 0, F.concat(n.cast("string"), F.lit(" numbers come from no computation: "), F.array_join(shown, ", ")))
    spliced = F.when(n > 0, F.aggregate("_spans", F.col(text), cut)).otherwise(F.col(text))
    return rows.select(*df.columns, spliced.alias("redacted"), n.alias("unverified"), message.alias("message"))
