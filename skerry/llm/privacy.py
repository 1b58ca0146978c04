"""Personal data in texts, and the terms that give it away: information-theoretic sanitisation in DataFrame functions.

Entities are the e-mail addresses, IP addresses, payment cards and phone numbers of a text, each kind leftmost and
non-overlapping.  A term is a word of ``MIN_TERM`` letters or more, without case.  Over all documents of the corpus,
n(t, e) counts those in which t stands within ``WINDOW`` characters of e, n(t), n(e) and N those with t, with e, and
all.  The information that t gives about e is PMI(t; e) = log2(N n(t, e) / (n(t) n(e))), and IC(e) = log2(N / n(e)) is
all that there is to protect; their difference, the bits that stay hidden, is the disclosure measure, alike at every
size of the corpus:

- at most ``REMOVE_BITS`` hidden: the term is removed;
- at most ``GENERALISE_BITS``: it is generalised to ``[name]`` (capitalised) or ``[word]``.

An entity protects nothing if it is in most documents (IC under ``LEAST_IC``).  A term counts as evidence if it is near e
in at least ``LEAST_EVIDENCE`` times as many documents as its commonest pair of neighbour words there: copies and near
copies of one text repeat that pair, however many they are.  Terms that disclose are looked for in every document, also
where the entity itself is missing, and outside the entities' own spans.  In the sanitised text entities become
``[email]`` and so on, kind by kind in the order of ``KINDS``, as far as the text has spans of the kind.

Defined cases: a null text is an empty one, without spans; repeated rows count each, get equal results; a null id is
carried; without entities, or in an empty table, there are no terms; columns named like
the results are replaced, others kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.llm.quality import let
from skerry.llm.shared import bounded, stage

WINDOW, MIN_TERM = 120, 3
REMOVE_BITS, GENERALISE_BITS, LEAST_IC = 0.32, 1.0, 1.0
LEAST_EVIDENCE = 3
#: A longer entity goes by its digest.
LONGEST_NAME = 254
MAX_BROADCAST_TERMS, MAX_BROADCAST_TEXTS = 1_000_000, 200_000
KINDS = ("email", "ip", "card", "phone")
#: Patterns are possessive and start where a run of their first characters does, so that time is linear in the text.
#: An address may also start where the one before it ended.  A card is a whole chain of 16 to 19 digits.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9][\x20-])(?<![0-9])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text needs to hold for its kind, so that most are not searched.
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
TERM = r"\p{L}{%d,}+" % MIN_TERM
#: Names that stand in an entity's place are no terms.
TERM_OR_NAME = rf"\[(?:{'|'.join(KINDS)})\]|{TERM}"
_SPAN = "array<struct<start:int,end:int,entity:string,near:string>>"


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether the check digit of a string of digits is right."""
    n = F.length(number)
    value = lambda i: F.substring(number, i, F.lit(1)).cast("int")
    doubled = lambda v: F.when(v > 4, v * 2 - 9).otherwise(v * 2)
    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda s, i: s + F.when((n - i) % 2 == 1, doubled(value(i))).otherwise(value(i)))
    return total % 10 == 0


def holds(kind: str, match: Column) -> Column:
    """Whether a match of the kind's pattern is one."""
    if kind == "ip":
        return match.rlike(r"^(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9]|(?<=0))(?:\.|$)){4}$")
    if kind == "card":
        return luhn(digits(match))
    if kind == "phone":
        return F.length(digits(match)).between(8, 15)
    return F.lit(True)


def normal(kind: str, match: Column) -> Column:
    """One form for all spellings of an entity."""
    form = {"email": F.lower(match), "ip": match}.get(kind, digits(match))
    return F.concat(F.lit(f"{kind}:"), F.when(F.length(form) > LONGEST_NAME, F.md5(form)).otherwise(form))


def running(sizes: Column) -> Column:
    """Sums of what stands before each entry.  In chunks of the root of the length, as growing an array copies it."""

    def rise(a: Column) -> Column:
        start = F.struct(F.array().cast("array<int>").alias("before"), F.lit(0).alias("sum"))
        return F.aggregate(a, start, lambda s, x: F.struct(F.concat(s["before"], F.array(s["sum"])).alias("before"), (s["sum"] + x).alias("sum")))

    def chunked(width: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.ceil(F.size(sizes) / width).cast("int") - 1), lambda k: rise(F.slice(sizes, k * width + 1, width)))
        return let(parts, lambda p: let(rise(F.transform(p, lambda x: x["sum"])), lambda tops: F.flatten(F.zip_with(p, tops["before"], lambda x, b: F.transform(x["before"], lambda y: y + b)))))

    return F.when(F.size(sizes) == 0, F.array().cast("array<int>")).otherwise(let(F.ceil(F.sqrt(F.size(sizes))).cast("int"), chunked))


def _near(gaps: Column, i: Column) -> Column:
    """The text around match ``i``, up to the next match of its kind; words that the window cuts are left out."""
    before, after = F.get(gaps, i), F.get(gaps, i + 1)
    left = F.when(F.length(before) > WINDOW, F.regexp_replace(F.right(before, F.lit(WINDOW)), r"^\p{L}+", "")).otherwise(before)
    right = F.when(F.length(after) > WINDOW, F.regexp_replace(F.left(after, F.lit(WINDOW)), r"\p{L}+$", "")).otherwise(after)
    return F.concat(left, F.lit(" "), right)


def spans(kind: str, text: Column, near: bool = False) -> Column:
    """(start, end, entity, near) of the kind in ``text``: code points, the end exclusive."""
    pattern = PATTERNS[kind]

    def placed(matches: Column) -> Column:
        def build(gaps: Column, starts: Column) -> Column:
            def one(m: Column, i: Column) -> Column:
                start = F.get(starts, i) + F.length(F.get(gaps, i))
                around = _near(gaps, i) if near else F.lit("")
                return F.struct(start.alias("start"), (start + F.length(m)).alias("end"), normal(kind, m).alias("entity"), around.alias("near"), holds(kind, m).alias("_held"))

            kept = F.filter(F.transform(matches, one), lambda x: x["_held"])
            return F.transform(kept, lambda x: F.struct(*(x[c].alias(c) for c in ("start", "end", "entity", "near"))))

        # what stands between matches, with empty strings kept, gives their places
        gaps = F.split(text, pattern, -1)
        return let(gaps, lambda g: let(running(F.zip_with(matches, F.slice(g, F.lit(1), F.size(matches)), lambda m, x: F.length(m) + F.length(x))), lambda starts: build(g, starts)))

    none = F.array().cast(_SPAN)
    found = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.when(F.size(m) == 0, none).otherwise(placed(m)))
    return F.when(F.contains(text, F.lit(NEEDS[kind])), found).otherwise(none) if NEEDS[kind] else found


def with_spans(docs: DataFrame, near: bool = False) -> DataFrame:
    """``docs`` (with ``_text``, never null) and a column of spans for each kind."""
    for kind in KINDS:
        docs = docs.withColumn(f"_{kind}", spans(kind, F.col("_text"), near))
    return docs


def evidence(docs: DataFrame) -> DataFrame:
    """(entity, term, neighbours): for each document once, the terms near each of its entities."""
    whole = with_spans(docs, near=True).select(F.concat(*(f"_{k}" for k in KINDS)).alias("all")).where(F.size("all") > 0)
    words = lambda x: F.transform(F.filter(F.split(x, r"[^\p{L}]+"), lambda w: w != ""), lambda w: F.lower(w))

    def terms(span: Column) -> Column:
        def each(ws: Column) -> Column:
            # the pair of neighbours, joined by a space, which no word holds
            made = F.transform(ws, lambda w, i: F.struct(span["entity"].alias("entity"), w.alias("term"), F.concat_ws(" ", F.coalesce(F.get(ws, i - 1), F.lit("")), F.coalesce(F.get(ws, i + 1), F.lit(""))).alias("neighbours")))
            return F.filter(made, lambda x: F.length(x["term"]) >= MIN_TERM)

        return let(words(span["near"]), each)

    found = F.sort_array(F.flatten(F.transform("all", terms)))
    first = lambda a: F.filter(a, lambda x, i: (i == 0) | (x["term"] != F.get(a, i - 1)["term"]) | (x["entity"] != F.get(a, i - 1)["entity"]))
    return whole.select(F.array_distinct(F.transform("all", lambda x: x["entity"])).alias("entities"), let(found, first).alias("pairs"))


def _distinct_terms(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), lambda w: F.lower(w)))


def disclosing(docs: DataFrame) -> DataFrame:
    """(term, entity, n_term, n_entity, n_both, ic, hidden) of the terms that give an entity away, by all documents."""
    found = stage(evidence(docs), "evidence")
    by_pair = found.select(F.explode("pairs").alias("p")).select("p.*").groupBy("entity", "term", "neighbours").agg(F.count("*").alias("n"))
    both = by_pair.groupBy("entity", "term").agg(F.sum("n").alias("n_both"), F.max("n").alias("_most")).where(F.col("n_both") >= LEAST_EVIDENCE * F.col("_most")).drop("_most")
    both = stage(both, "candidates")
    terms = stage(both.select("term").distinct(), "terms")
    if terms.isEmpty():
        counted = both.select("term").withColumn("n_term", F.lit(0).cast("long"))
        n_docs = 0
    else:
        asked = bounded(terms, MAX_BROADCAST_TERMS)
        held = docs.select(F.explode(_distinct_terms(F.col("_text"))).alias("term"))
        counted = stage(held.join(asked, "term").groupBy("term").agg(F.count("*").alias("n_term")), "term-counts")
        n_docs = docs.count()
    entities = found.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("n_entity"))
    # an entity may cut a run of letters, so that a term of its surroundings is none of the whole text
    known = both.join(counted, "term").join(entities, "entity").withColumn("n_term", F.greatest("n_term", "n_both"))
    known = known.withColumn("ic", F.log2(F.lit(float(max(n_docs, 1))) / F.col("n_entity"))).withColumn("hidden", F.log2(F.col("n_term") / F.col("n_both")))
    return known.where((F.col("ic") >= LEAST_IC) & (F.col("hidden") <= GENERALISE_BITS)).select("term", "entity", "n_term", "n_entity", "n_both", "ic", "hidden")


def _hits(docs: DataFrame, actions: DataFrame) -> DataFrame:
    """(_hash, _size, terms): per text the terms in it that disclose, with whether they are removed."""
    words = docs.select(F.xxhash64("_text").alias("_hash"), F.length("_text").alias("_size"), F.explode(_distinct_terms(F.col("_text"))).alias("term"))
    return words.join(bounded(actions, MAX_BROADCAST_TERMS), "term").groupBy("_hash", "_size").agg(F.collect_set(F.struct("term", "removed")).alias("_terms"))


def _term_spans(text: Column, terms: Column, taken: Column) -> Column:
    """(start, end, removed) of the listed terms outside the spans ``taken``."""

    def placed(matches: Column, gaps: Column) -> Column:
        starts = running(F.zip_with(matches, F.slice(gaps, F.lit(1), F.size(matches)), lambda m, x: F.length(m) + F.length(x)))

        def one(m: Column, i: Column, s: Column) -> Column:
            hit = F.get(F.filter(terms, lambda t: t["term"] == F.lower(m)), 0)
            start = F.get(s, i) + F.length(F.get(gaps, i))
            return F.struct(start.alias("start"), (start + F.length(m)).alias("end"), hit["removed"].alias("removed"), m.alias("term"))

        listed = lambda x: x["removed"].isNotNull() & ~F.exists(taken, lambda t: (t["start"] < x["end"]) & (x["start"] < t["end"]))
        return let(starts, lambda s: F.filter(F.transform(matches, lambda m, i: one(m, i, s)), listed))

    return let(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), lambda m: let(F.split(text, TERM, -1), lambda g: placed(m, g)))


def _masked(text: Column, kind: str) -> Column:
    """``text`` with the kind's entities replaced by its name in brackets."""
    return let(text, lambda t: _masked_once(t, kind))


def _masked_once(text: Column, kind: str) -> Column:
    pattern, to = PATTERNS[kind], F.lit(f"[{kind}]")
    put = lambda m, g: F.concat(F.array_join(F.zip_with(m, F.slice(g, F.lit(1), F.size(m)), lambda x, before: F.concat(before, F.when(holds(kind, x), to).otherwise(x))), ""), F.element_at(g, -1))
    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.when(F.size(m) == 0, text).otherwise(let(F.split(text, pattern, -1), lambda g: put(m, g))))


def _cut(text: Column, terms: Column) -> Column:
    """``text`` with the listed terms removed or generalised."""

    def put(m: Column, g: Column) -> Column:
        def now(x: Column) -> Column:
            general = F.when(x.rlike(r"^\p{Lu}"), "[name]").otherwise("[word]")
            return let(F.get(F.filter(terms, lambda t: t["term"] == F.lower(x)), 0), lambda t: F.when(t.isNull(), x).when(t["removed"], "").otherwise(general))

        return F.concat(F.array_join(F.zip_with(m, F.slice(g, F.lit(1), F.size(m)), lambda x, before: F.concat(before, now(x))), ""), F.element_at(g, -1))

    return let(F.regexp_extract_all(text, F.lit(TERM_OR_NAME), F.lit(0)), lambda m: let(F.split(text, TERM_OR_NAME, -1), lambda g: put(m, g)))


def sanitise(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """``docs`` with ``found``, a struct of the spans (start, end) by kind and ``term``, and ``sanitised``, the text without them."""
    row = F.struct(*(F.col(c) for c in docs.columns if c not in ("found", "sanitised"))).alias("_row")
    rows = docs.select(row, F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("_text"))
    actions = stage(disclosing(rows.select("_text")).groupBy("term").agg((F.min("hidden") <= REMOVE_BITS).alias("removed")), "disclosing")
    none = F.array().cast("array<struct<term:string,removed:boolean>>")
    if actions.isEmpty():
        rows = rows.withColumn("_terms", none)
    else:
        hits = bounded(stage(_hits(rows.select("_text"), actions), "hits"), MAX_BROADCAST_TEXTS)
        rows = rows.withColumns({"_hash": F.xxhash64("_text"), "_size": F.length("_text")}).join(hits, ["_hash", "_size"], "left").withColumn("_terms", F.coalesce("_terms", none))
    rows = with_spans(rows)
    plain = lambda c: F.transform(c, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    taken = F.concat(*(plain(F.col(f"_{k}")) for k in KINDS))
    none = F.array().cast("array<struct<start:int,end:int>>")
    rows = rows.withColumn("_term", F.when(F.size("_terms") == 0, none).otherwise(plain(_term_spans(F.col("_text"), F.col("_terms"), taken))))
    text = F.col("_text")
    for kind in KINDS:
        text = F.when(F.size(f"_{kind}") == 0, text).otherwise(_masked(text, kind))
    text = F.when(F.size("_terms") == 0, text).otherwise(let(text, lambda t: _cut(t, F.col("_terms"))))
    found = F.struct(*(plain(F.col(f"_{k}")).alias(k) for k in KINDS), F.col("_term").alias("term"))
    return rows.select("_row.*", found.alias("found"), text.alias("sanitised"))


def listed(found: Column, kinds: tuple[str, ...]) -> Column:
    """The spans as ``kind:start:end``, by kind and start, joined by commas."""
    one = lambda k: F.transform(found[k], lambda x: F.concat_ws(":", F.lit(k), x["start"].cast("string"), x["end"].cast("string")))
    return F.array_join(F.concat(*(one(k) for k in kinds)), ",")
