"""Quality rules by distribution divergence, in DataFrame functions only.

Base counts over words ``[^\\x20\\x09-\\x0D]+`` of the whole text decide ``base_failed``.  The
verdict on the rest compares two histograms of the document with those of each reference language
by Jensen-Shannon distance (square root of the divergence in bits): character classes, and common
words (the words of each language's list, and all others together).  Every ``lang`` value of the table is a
reference language.  Its list are the ``LISTED`` words that most of its documents of at least 50 words hold; all words
of all of them are counted.  Its histograms are sums over all its documents that pass the base rules.  A document is kept if
some language is near in both; a histogram over few characters or words is noise, so shorter documents are not judged
by it.

Defined cases: a null or empty text has no words and fails the base rules; a null or blank ``lang`` makes no
reference; without any reference there is no verdict and the base rules decide; ties of listed words go to the
first in order, ties of languages to the first name; repeated rows are judged alike, a null id is carried, other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skerry.llm.shared import stage

#: Words of a language's list.
LISTED = 40
MIN_LISTING_WORDS = 50
SYMBOLS = "[#*$%&|<>]"
#: Character classes that are counted, beside lower-case letters, white space and all others (regular expressions of what is no member).
CLASSES = {"upper": r"[^\p{Lu}]+", "digit": r"[^\p{Nd}]+", "point": r"[^.,;:!?'\"()-]+", "symbol": r"[^#*$%&|<>]+"}
LOWER_OR_SPACE = r"[\p{Ll}\x20\x09-\x0D]+"
MIN_CHARS, MIN_WORDS = 200, 150
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = 0.28, 0.34


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row, also where lambdas use it many times."""
    return F.element_at(F.transform(F.array(value), body), 1)


def split_words(text: Column) -> Column:
    for c in "\t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.filter(F.split(text, " "), lambda w: w != "")


def window_hashes(words: Column) -> Column:
    """Hashes of the 3-word windows in order; null without at least two."""
    return F.when(F.size(words) > 3, F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))))


def repeated_words(hashes: Column) -> Column:
    """How many words stand in a 3-word window that the text holds twice or more."""

    def marked(windows: Column) -> Column:
        same = lambda k, h: F.coalesce(F.get(windows, k)["h"] == h, F.lit(False))
        places = F.transform(F.filter(windows, lambda x, k: same(k - 1, x["h"]) | same(k + 1, x["h"])), lambda x: x["i"])
        return let(F.sort_array(places), lambda p: F.aggregate(F.transform(p, lambda x, k: F.when(k == 0, 3).otherwise(F.least(F.lit(3), x - F.get(p, k - 1)))), F.lit(0), lambda a, x: a + x))

    windows = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    # most short texts repeat no window, and need no sort
    return F.when(hashes.isNull() | (F.size(F.array_distinct(hashes)) == F.size(hashes)), 0).otherwise(let(F.sort_array(windows), marked))


def histogram(words: Column, known: list[str]) -> Column:
    """(word, count) of the known words."""
    none = F.array().cast("array<struct<word:string,n:int>>")
    if not known:
        return none
    found = F.sort_array(F.filter(words, lambda w: w.isin(known)))

    def runs(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return let(starts, lambda at: F.transform(at, lambda i, k: F.struct(F.get(s, i).alias("word"), (F.coalesce(F.get(at, k + 1), F.size(s)) - i).alias("n"))))

    return let(found, lambda s: F.when(F.size(s) == 0, none).otherwise(runs(s)))


def features(docs: DataFrame, *carried: str, known: list[str]) -> DataFrame:
    """Base counts and histograms of every whole text, beside the ``carried`` columns."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # columns in steps, so that each is computed once
    rows = docs.select(*carried, text.alias("_t")).select(
        *carried, F.length("_t").cast("long").alias("n_all"), split_words(F.col("_t")).alias("_w"), F.filter(F.split("_t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"), F.regexp_replace("_t", LOWER_OR_SPACE, "").alias("_rest")
    )
    rows = rows.select(*carried, "n_all", "_w", "_lines", "_rest", window_hashes(F.col("_w")).alias("_h"))
    got = rows.select(
        *carried,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        repeated_words(F.col("_h")).cast("long").alias("n_repeat_words"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        "n_all",
        histogram(F.col("_w"), known).alias("common"),
        F.length("_rest").cast("long").alias("_left"),
        *(F.length(F.regexp_replace("_rest", p, "")).cast("long").alias(k) for k, p in CLASSES.items()),
    )
    got = got.withColumn("n_symbols", F.col("symbol")).withColumn("lower", F.col("word_chars") - F.col("_left")).drop("_left")
    return got.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def char_counts() -> Column:
    """Counts of the classes, of white space, and of all other characters."""
    space = F.col("n_all") - F.col("word_chars")
    counted = ["lower", *CLASSES]
    rest = F.col("n_all") - space - sum((F.col(k) for k in counted), F.lit(0))
    return F.array(*(F.col(k) for k in counted), space, F.greatest(rest, F.lit(0)))


def _most_held(words: DataFrame, most: int) -> dict[str, list[str]]:
    """Per language the words of (lang, word) rows, one a document, that most documents hold: at most ``most`` each."""
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("count"), "word"))
    found: dict[str, list[str]] = {}
    for r in words.groupBy("lang", "word").count().withColumn("rank", rank).where(F.col("rank") <= most).collect():
        found.setdefault(r["lang"], []).append(r["word"])
    return found


def word_lists(docs: DataFrame) -> dict[str, list[str]]:
    """The common words of every language of (text, lang): those that most of its documents hold, by all words of all of them."""
    words = docs.where("lang is not null").select("lang", split_words(F.col("text").cast("string")).alias("w"))
    return _most_held(words.select("lang", F.explode(F.when(F.size("w") >= MIN_LISTING_WORDS, F.array_distinct("w"))).alias("word")), LISTED)


def references(found: DataFrame, lists: dict[str, list[str]]) -> dict[str, tuple[list[float], dict[str, float]]]:
    """Per language its class shares, and the shares of its common words; sums over all documents that pass the base rules."""
    good = found.where(~F.col("base_failed") & F.col("lang").isin(list(lists)))
    n = len(CLASSES) + 3
    chars = good.groupBy("lang").agg(F.sum("n_words").alias("n_words"), *(F.sum(F.get(char_counts(), F.lit(i))).alias(f"c{i}") for i in range(n)))
    common = good.select("lang", F.explode("common").alias("x")).groupBy("lang", "x.word").agg(F.sum("x.n").alias("n"))
    # at most one row a language, and one a language and word of its list or of another
    counted = {r["lang"]: r for r in chars.collect()}
    shares: dict[str, dict[str, float]] = {k: {} for k in counted}
    for r in common.collect():
        if r["word"] in lists[r["lang"]]:
            shares[r["lang"]][r["word"]] = r["n"] / counted[r["lang"]]["n_words"]
    return {k: ([r[f"c{i}"] / max(1, sum(r[f"c{j}"] for j in range(n))) for i in range(n)], shares[k]) for k, r in sorted(counted.items())}


def part(p: Column, q: Column) -> Column:
    """What one pair of shares adds to the Jensen-Shannon divergence, in bits."""
    half = lambda x, y: F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(0.0) / 2
    return half(p, q) + half(q, p)


def distances(reference: Column) -> Column:
    """Struct of the distances of a document's two histograms to a language's (lang, shares, words, listed)."""
    total = F.greatest(F.col("n_all"), F.lit(1)).cast("double")
    chars = sum((part(F.get(char_counts(), F.lit(i)) / total, F.get(reference["shares"], F.lit(i))) for i in range(len(CLASSES) + 3)), F.lit(0.0))
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    own = F.filter("common", lambda e: F.map_contains_key(reference["words"], e["word"]))
    start = F.struct(F.lit(0.0).alias("d"), F.lit(0.0).alias("p"), F.lit(0.0).alias("q"))

    def add(a: Column, e: Column) -> Column:
        p, q = e["n"] / n, F.element_at(reference["words"], e["word"])
        return F.struct((a["d"] + part(p, q)).alias("d"), (a["p"] + p).alias("p"), (a["q"] + q).alias("q"))

    listed = reference["listed"]
    # words of the list that the document lacks add half their share; the last bucket holds all other words
    finish = lambda a: a["d"] + F.greatest(listed - a["q"], F.lit(0.0)) / 2 + part(F.greatest(1 - a["p"], F.lit(0.0)), F.greatest(1 - listed, F.lit(0.0)))
    root = lambda x: F.sqrt(F.greatest(x, F.lit(0.0)))
    return F.struct(root(chars).alias("chars"), root(F.aggregate(own, start, add, finish)).alias("words"))


def judge(docs: DataFrame, id_column: str = "doc_id", *carried: str) -> DataFrame:
    """Every document's base counts, ``base_failed``, distances to the nearest language, and ``kept``."""
    lang = docs["lang"].cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col(id_column), *carried, F.col("text"), F.when(F.trim(lang) != "", lang).alias("lang"))
    lists = word_lists(rows)
    found = stage(features(rows, id_column, *carried, "lang", known=sorted({w for ws in lists.values() for w in ws})), "quality")
    known = references(found, lists)
    base = [id_column, *carried, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    if not known:
        return found.select(*base, F.lit(None).cast("string").alias("nearest"), F.lit(None).cast("double").alias("char_distance"), F.lit(None).cast("double").alias("word_distance"), (~F.col("base_failed")).alias("kept"))
    table = lambda words: F.create_map(*(F.lit(x) for kv in words.items() for x in kv)) if words else F.create_map().cast("map<string,double>")
    # one literal row a language
    asked = F.array(*(F.struct(F.lit(k).alias("lang"), F.array(*map(F.lit, shares)).alias("shares"), table(words).alias("words"), F.lit(float(sum(words.values()))).alias("listed")) for k, (shares, words) in known.items()))
    options = F.transform(asked, lambda r: let(distances(r), lambda d: F.struct((d["chars"] + d["words"]).alias("sum"), r["lang"].alias("lang"), d.alias("d"))))
    judged = found.withColumn("best", F.array_min(options))
    far = ((F.col("n_all") >= MIN_CHARS) & (F.col("best.d.chars") > MAX_CHAR_DISTANCE)) | ((F.col("n_words") >= MIN_WORDS) & (F.col("best.d.words") > MAX_WORD_DISTANCE))
    return judged.select(*base, F.col("best.lang").alias("nearest"), F.col("best.d.chars").alias("char_distance"), F.col("best.d.words").alias("word_distance"), (~F.col("base_failed") & ~F.coalesce(far, F.lit(False))).alias("kept"))
