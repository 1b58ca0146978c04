"""Operators on small tables: definitions, edge cases, and what must not happen."""

import datetime as dt
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from skerry.operators import diversity, governance, groups, guards, lab, neighbours, resample, sequences, series, validate
from skerry.operators.validate import Rule
from skerry.plans import compare, registry
from skerry.sources import tables
from skerry.streaming import ledgers


def measured(spark, parts):
    return spark.createDataFrame([(g, float(v)) for g, vs in parts.items() for v in vs], "g string, v double")


def test_describe_drops_what_is_not_finite(spark):
    df = measured(spark, {"a": [1, 2, 3, float("nan"), float("inf")], "b": [5]})
    got = {r["group_label"]: r for r in groups.describe(df, "g", "v").collect()}
    assert (got["a"]["n"], got["a"]["mean"], got["a"]["median"], got["b"]["sd"]) == (3, 2.0, 2.0, 0.0)


def test_ranks_share_ties(spark):
    df = measured(spark, {"a": [1, 2, 2, 5], "b": [2, 3, 5, 5]})
    got = groups.pairwise_ranks(df, "g", "v", "a", "b").first()
    pairs = [(x > y) + (x == y) / 2 for x in (1, 2, 2, 5) for y in (2, 3, 5, 5)]
    assert got["u"] == sum(pairs) and got["cles"] == pytest.approx(np.mean(pairs)) and got["tie_term"] == 24 + 24


def test_running_sum_over_ranges(spark):
    from skerry.functions.columns import running_sum

    df = spark.range(500).select((F.col("id") % 3).alias("k"), "id", (F.col("id") % 7).alias("x"))
    got = {r["id"]: r["upto"] for r in running_sum(df, ["k"], ["id"], "x", "upto").collect()}
    assert all(got[i] == sum(j % 7 for j in range(i % 3, i + 1, 3)) for i in range(500))


def test_routes_and_refusals(spark):
    r = np.random.default_rng(1)
    sets = {
        "equal": {"a": r.normal(0, 1, 40), "b": r.normal(3, 1, 40)}, "unequal": {"a": r.normal(0, 1, 40), "b": r.normal(0, 9, 40)}, "small": {"a": [1, 2, 3, 4], "b": [10, 11, 12, 13]},
        "three": {"a": r.normal(0, 1, 30), "b": r.normal(0, 1, 30), "c": r.normal(2, 1, 30)}, "few": {"a": [1, 2], "b": [3, 4, 5]}, "one": {"a": [1, 2, 3]},
    }
    df = spark.createDataFrame([(s, g, float(v)) for s, gs in sets.items() for g, vs in gs.items() for v in vs], "s string, g string, v double")
    got = {x["s"]: x for x in compare.compare_groups(df, "g", "v", ["s"]).collect()}
    assert [got[s]["route"] for s in ("equal", "unequal", "small", "three")] == ["ttest_ind", "welch", "permutation", "anova"]
    assert got["few"]["refused"] and got["one"]["refused"] and got["few"]["p_value"] is None and "fewer" in got["few"]["reason"]
    assert got["equal"]["p_value"] < 1e-6 and got["small"]["p_value"] == pytest.approx(2 / 70)


def test_permutation_route_at_every_size(spark):
    """The mean difference is permuted beyond one task's values too: p agrees with shuffles of the whole."""
    from skerry.functions import exact

    r = np.random.default_rng(8)
    sets = {
        "even": {"a": r.exponential(1, 300), "b": r.exponential(1.12, 300)}, "ties": {"a": r.poisson(0.5, 30000) ** 2, "b": r.poisson(0.502, 9000) ** 2},
        "large": {"a": r.exponential(1, 9000), "b": r.exponential(1.02, 4000)}, "under": {"a": r.exponential(1, 200), "b": r.exponential(1.2, 200)},
    }
    df = spark.createDataFrame([(s, g, float(v)) for s, gs in sets.items() for g, vs in gs.items() for v in vs], "s string, g string, v double")
    got = {x["s"]: x for x in compare.compare_groups(df, "g", "v", ["s"], prefer_robust=True).collect()}
    for s, parts in sets.items():
        want = exact.permutation_p(np.asarray(parts["a"], float), np.asarray(parts["b"], float), limit=1999)[0]
        assert got[s]["route"] == "permutation" and got[s]["statistic"] == pytest.approx(np.mean(parts["a"]) - np.mean(parts["b"]))
        assert got[s]["p_value"] == pytest.approx(want, abs=0.06)
    again = compare.compare_groups(df.repartition(7).where("s = 'even'"), "g", "v", prefer_robust=True).first()
    assert again["p_value"] == got["even"]["p_value"]


def test_ledger_counts_every_test(spark):
    rows = [(f"t{i}", i, "compare", "d", None, None, 0.02, 0.1, 30 - i, None, None, 1.0) for i in range(4)] + [("t9", 9, "compare", "d", None, None, 0.01, 0.1, 5, "failed", None, 1.0)]
    store = spark.createDataFrame(rows, governance.TRANSCRIPT)
    got = governance.ledger(store).collect()
    assert len(got) == 4 and all(r["tests"] == 4 and r["corrected"] == pytest.approx(0.08) and r["lost"] for r in got)
    assert governance.behaviour(store).first()["severity"] == "block"
    assert governance.append_new(store, store).count() == 0


def test_fingerprint_ignores_order(spark):
    df = spark.createDataFrame([(i, i * 0.5) for i in range(50)], "i int, v double")
    same = governance.fingerprint(df, "i", "v").first()["data_id"]
    assert governance.fingerprint(df.orderBy(F.desc("i")), "i", "v").first()["data_id"] == same != governance.fingerprint(df.limit(49), "i", "v").first()["data_id"] and len(same) == 32


def test_records(spark):
    log = spark.createDataFrame([("d", "up", 1), ("d", "down", 2)], "data_id string, prediction string, version int")
    assert governance.predictions(log).first().asDict() == {"data_id": "d", "prediction": "up", "amendments": 1}
    reasons = spark.createDataFrame([("tube cracked",), ("it was not significant",), ("",)], "justification string")
    assert [r["accepted"] for r in governance.exclusions(reasons).collect()] == [True, False, False]
    claimed = spark.createDataFrame([("a", 0.01, 0.5, 2.0), ("b", 0.02, 0.5, 2.0)], "transcript_id string, p_value double, effect_size double, statistic double")
    own = spark.createDataFrame([("a", 0.01, 0.5, 2.0), ("b", 0.2, 0.5, 2.0)], "transcript_id string, p_value double, effect_size double, statistic double")
    assert {r["transcript_id"]: r["mismatches"] for r in governance.verify(claimed, own).collect()} == {"a": [], "b": ["p_value"]}


def test_zero_sample_and_unknown_metric(spark):
    counts = spark.createDataFrame([("a", "x", 3), ("a", "y", 1), ("b", "x", 0)], "sample string, taxon string, n int")
    got = {r["sample"]: r for r in diversity.alpha(counts).collect()}
    assert got["b"]["shannon"] == 0.0 and got["b"]["observed"] == 0 and got["a"]["observed"] == 2
    with pytest.raises(ValueError):
        diversity.beta(counts, "unheard_of")
    sums = diversity.clr(counts).groupBy("sample").agg(F.sum("clr").alias("s")).collect()
    assert all(abs(r["s"]) < 1e-12 for r in sums)


def test_sequences(spark):
    df = spark.createDataFrame([(1, "ATGAAATTTTAACC")], "id int, s string")
    assert df.select(sequences.reverse_complement(sequences.reverse_complement(F.col("s"))).alias("x")).first()["x"] == "ATGAAATTTTAACC"
    assert sequences.translate(df, "s").first()["protein"] == "MKF*" and sequences.translate(df, "s", to_stop=True).first()["protein"] == "MKF"
    orf = sequences.orfs(df, "s", "id", 3).where("frame = 1").first()
    assert (orf["first_base"], orf["last_base"], orf["amino_acids"]) == (1, 12, 3)
    assert {r["kmer"]: r["n"] for r in sequences.kmers(df, "s", ["id"]).collect()}["TTTT"] == 1
    cover = spark.createDataFrame([(1, 1, 10), (1, 5, 12), (1, 20, 21)], "id int, first_base int, last_base int")
    assert sequences.coverage(cover, "id").first()["covered"] == 14


def test_fasta(spark, tmp_path):
    text = "junk\n>s1 first\nACGU\nNN\n\n>\nac gt\n"
    got = {r["seq_id"]: r for r in tables.parse_fasta(spark.createDataFrame([(1, text)], "k int, t string"), "k", "t").collect()}
    assert got["s1"]["sequence"] == "ACGT" and got["s1"]["non_standard"] == 2 and got["record_2"]["sequence"] == "ACGT"
    (tmp_path / "x.fa").write_text(">a one\nAC\nGT\n>b\nTTTT\n")
    assert {r["seq_id"]: r["sequence"] for r in tables.read_fasta(spark, str(tmp_path / "x.fa")).collect()} == {"a": "ACGT", "b": "TTTT"}
    (tmp_path / "t.txt").write_text("p;q\n1; 2\n")
    assert tables.read_delimited(spark, str(tmp_path / "t.txt")).first().asDict() == {"p": "1", "q": "2"}


def test_read_fasta_ignores_what_stands_before_the_first_header(spark, tmp_path):
    from skerry.sources import tables

    (tmp_path / "a.fa").write_text("junk line\n>one first\nACGT\nAC\n>\nGGCC\n")
    (tmp_path / "b.fa").write_text(">two\nTTuu")
    got = sorted((r["description"], r["sequence"], r["length"]) for r in tables.read_fasta(spark, str(tmp_path)).collect())
    assert got == [("", "GGCC", 4), ("one first", "ACGTAC", 6), ("two", "TTTT", 4)]
    assert all(r["seq_id"] for r in tables.read_fasta(spark, str(tmp_path)).collect())


def test_duplicate_vectors_make_no_self_loops(spark):
    v = spark.createDataFrame([(i, [1.0, 0.0] if i < 3 else [0.0, float(i)]) for i in range(6)], "k int, v array<double>")
    pairs = neighbours.cosine_pairs(v, "k", "v")
    edges = neighbours.knn_edges(pairs, 2).collect()
    assert all(e["i"] < e["j"] for e in edges) and {(0, 1), (0, 2), (1, 2)} <= {(e["i"], e["j"]) for e in edges}
    assert neighbours.components(neighbours.knn_edges(pairs, 2).withColumn("w", F.lit(1))).select("label").distinct().count() == 2


def test_complete_graph_has_positive_curvature(spark):
    edges = spark.createDataFrame([(i, j, 1.0) for i in range(6) for j in range(i + 1, 6)], "i int, j int, d double")
    assert neighbours.ollivier_ricci(edges).agg(F.min("curvature")).first()[0] > 0


def test_validation(spark):
    df = spark.createDataFrame([(0, "1", "7.2"), (1, "x", "19"), (2, None, "n/a"), (3, "1", "7.2")], "row int, sample string, pH string")
    issues = {(r["severity"], r["row_num"], r["column_name"], r["rule"]) for r in validate.validate(df, "row", [Rule("sample", "text"), Rule("pH", "number", False, 0, 14), Rule("nitrate", "number")]).collect()}
    assert issues == {("block", 3, "pH", "above_maximum"), ("warn", 4, "sample", "missing_value"), ("block", None, "nitrate", "missing_column"), ("warn", 5, None, "duplicate_row")}
    kept, dropped = validate.coerce(df.withColumn("pH", F.when(F.col("row") == 1, "warm 19x e").otherwise(F.col("pH"))), ["pH"])
    assert kept.count() == 3 and dropped.count() == 1
    assert validate.suggest_template(["sample", "pH", "nitrate_ppm"]) == "water_quality" and validate.suggest_template(["q"]) is None


def test_guards(spark):
    t = spark.createDataFrame([("Ask Maya at maya.k@school.org or 9876543210, near 12.97160, 77.59460",)], "t string")
    shown = t.select(guards.redact(F.col("t"), ("Maya",)).alias("x")).first()["x"]
    assert shown == "Ask [STUDENT] at [EMAIL] or [PHONE], near [COORDS]"
    s = spark.createDataFrame([(1, "p = .023 and d = 0.81, mean 4.56 in grade 7 of 12 tubes")], "k int, t string")
    known = spark.createDataFrame([(1, 0.0231), (1, 4.557)], "k int, value double")
    assert sorted((r["kind"], r["number"]) for r in guards.scan_numbers(s, "k", "t", known).collect()) == [("effect_size", 0.81), ("integer", 12.0)]
    p = spark.createDataFrame([(1, "pip install ete3 pandas==2\nimport igraph.core")], "k int, t string")
    assert {(r["package"], r["issue"]) for r in guards.package_issues(p, "k", "t").collect()} == {("ete3", "name"), ("igraph", "GPL-2")}
    assert [r["ok"] for r in spark.createDataFrame([(30,), (100,)], "n int").select(guards.sample_size(F.col("n"), "umap", F.lit(60)).alias("ok")).collect()] == [False, True]


def spotted(spark, texts, guard):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    return {r["t"]: r["c"] for r in df.select("t", guard(F.col("t")).alias("c")).collect()}


def test_claims(spark):
    """Phrases in order within a sentence; negations, other orders and other sentences pass."""
    texts = {
        "On our t-SNE map the soil samples lie far from the river samples.": ["umap_distance"],
        "Look how close both strains are in the UMAP!": ["umap_distance"],
        "Sunlight is correlated with height (r = 0.7) and thus drives it.": ["causation"],
        "We saw an association between salt and pH; in short it shows. Salt causes rust.": [],
        "The result is not significant, which means there is no effect of salt.": ["accepting_null"],
        "With p = 0.51 we can say that this proves the two soils are the same.": ["accepting_null"],
        "p was 0.3, so both ponds are equal.": ["accepting_null"],
        "Four clusters came out, which proves that four real families exist.": ["cluster_reification"],
        "The k-means run shows exactly 3 species": ["cluster_reification"],
        "A correlation does not prove anything, and p = 0.4 doesn't show that there is no effect.": [],
        "Clusters never confirm real groups.": [],
        "": [],
        None: [],
    }
    assert spotted(spark, texts, guards.blocked_claims) == texts


def test_searches(spark):
    texts = {
        "Could you run some other model on it": [1], "Please leave out that point, it looks odd": [2], "take the third tube out": [2], "what if i left day two aside": [3], "keep going until the result is significant": [4],
        "plot it without the weird one": [5], "Let us regroup the ponds.": [6], "can we make it significant": [7], "how do I get p below 0.05?": [7], "is this p-hacking?": [8],
        "Report uncertainty across specifications.": [9], "we check robustness across all model specifications": [10], "please plot the growth curve": [], None: [],
    }
    assert spotted(spark, texts, guards.searching) == texts


def test_ordinary_sentences_pass(spark):
    ordinary = [
        "We measured each sample without a filter.", "We get a reading of 0.05 mg per litre.", "Significant rain means no sampling today.", "The p value is in the table and the two plates show the same volume.",
        "Use another pipette for the next tube.", "The lake is far from the school, as the map shows.", "Remove the lid and wait five minutes.", "Try to keep different soils apart.", "The test was significant.",
        "A cluster of trees shows where the spring is.", "Both groups are the same size.", "The association of teachers meets on Monday, therefore the lab is closed on Tuesday.", "Stir until the salt is gone.", "We made a significant effort.",
    ]
    passed = {t: [] for t in ordinary if "association of teachers" not in t}
    assert spotted(spark, passed, guards.blocked_claims) == passed
    assert spotted(spark, ordinary, guards.searching) == {t: [] for t in ordinary}


def test_redaction_takes_linear_time(spark):
    """A word of a megabyte costs no more than one of the usual length; long addresses lose at least what stands by the sign."""
    texts = ["a" * 1_000_000, "b" * 500_000 + "@" + "c" * 500_000, "1" * 1_000_000, "1.11111 " * 100_000]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(F.length(guards.redact(F.col("t"))).alias("n"))
    spark.createDataFrame([("a@b.cd",)], "t string").select(guards.redact(F.col("t"))).collect()
    began = time.perf_counter()
    sizes = [r["n"] for r in df.collect()]
    assert time.perf_counter() - began < 8
    assert sizes[0] == 1_000_000 and sizes[1] == 1_000_001 - 64 - 1 - 255 + len("[EMAIL]")


def test_numbers_and_their_redaction(spark):
    rows = [(1, "The difference is clear, t(28) = 2.41, p = .023, with d = 0.91."), (2, "p = 0.0031 and 45 % of 1,250 plates, which is striking"), (3, "There were 4 levels in grade 12, n = 30."), (4, None), (5, "mean 4.56")]
    df = spark.createDataFrame(rows, "k int, t string")
    known = spark.createDataFrame([(2, 0.4503), (5, 4.5612), (2, 1250.0)], "k int, value double")
    got = {(r["k"], r["kind"], r["number"]) for r in guards.scan_numbers(df, "k", "t", known).collect()}
    assert got == {(1, "test_statistic", 28.0), (1, "test_statistic", 2.41), (1, "p_value", 0.023), (1, "effect_size", 0.91), (2, "p_value", 0.0031)}
    out = {r["k"]: r for r in guards.redact_numbers(df, "k", "t", known, allowed=(28.0,)).collect()}
    assert out[1]["redacted"] == "The difference is clear, t(28) = [UNVERIFIED], p = [UNVERIFIED], with d = [UNVERIFIED]." and out[1]["unverified"] == 3
    assert out[1]["message"] == "3 numbers come from no computation: #.##, .###, #.##"
    assert out[2]["redacted"].endswith("which is striking") and out[3]["redacted"] == rows[2][1] and out[4]["redacted"] is None and out[5]["message"] is None


def test_package_names(spark):
    df = spark.createDataFrame([(1, "pip install drc jellyfish basico"), (2, "conda install -y pingouin==0.5 giotto-tda[all]"), (3, "from igraph.core import x\nwe install nothing"), (4, None)], "k int, t string")
    got = sorted((r["k"], r["package"], r["issue"]) for r in guards.package_issues(df, "k", "t").collect())
    assert got == [(1, "basico", "name"), (1, "drc", "name"), (1, "jellyfish", "name"), (2, "giotto-tda", "AGPL-3"), (2, "pingouin", "GPL-3"), (3, "igraph", "GPL-2")]


def test_effects_in_words(spark):
    df = spark.createDataFrame([(0.1, None, None), (0.25, None, None), (-0.6, -1.0, 0.2), (0.9, 0.1, 1.5), (float("nan"), None, None)], "v double, a double, b double")
    words = [r["w"] for r in df.select(groups.interpret(F.col("v"), "hedges_g", F.col("a"), F.col("b")).alias("w")).collect()]
    assert words == ["negligible", "small", "moderate here, but the interval holds 0, so the direction is open", "large", "not estimable"]
    assert df.select(groups.interpret(F.lit(0.1), "epsilon_squared").alias("w")).first()["w"] == "moderate"


def test_null_keys_and_clashing_names(spark):
    rows = [(k, g, float(v + 3 * (g == "b"))) for k in (None, "x") for g in "ab" for v in (1, 2, 3, 4, 5, 7)]
    df = spark.createDataFrame(rows, "k string, g string, v double")
    got = {r["k"]: (r["route"], r["p_value"]) for r in compare.compare_groups(df, "g", "v", ["k"]).collect()}
    assert got[None] == got["x"] and got["x"][1] is not None
    assert groups.anova(df, "g", "v", ["k"]).count() == 2
    labels = df.withColumn("g", F.when(F.col("g") == "a", F.col("g")))
    assert groups.brown_forsythe(labels, "g", "v").first()["df_between"] == 1


def test_correlation_contingency_and_trend(spark):
    small = spark.createDataFrame([(float(i), float(i * i)) for i in range(6)], "x double, y double")
    r = compare.correlate(small, "x", "y").first()
    assert r["route"] == "spearman" and r["coefficient"] == pytest.approx(1) and r["p_value"] < 1e-6
    assert compare.correlate(small.limit(3), "x", "y").first()["refused"]
    table = spark.createDataFrame([("a", "x")] * 1 + [("a", "y")] * 4 + [("b", "x")] * 5 + [("b", "y")] * 1, "r string, c string")
    f = compare.contingency_test(table, "r", "c").first()
    assert f["route"] == "fisher" and f["p_value"] == pytest.approx(0.0801, abs=1e-3)
    series = spark.createDataFrame([("up", i, i + (i % 3) * 0.5) for i in range(20)] + [("flat", i, float((i * 7) % 5)) for i in range(20)], "s string, t int, v double")
    got = {r["s"]: r for r in compare.trend_test(series, "t", "v", ["s"]).collect()}
    assert got["up"]["direction"] == "increasing" and got["up"]["low"] <= got["up"]["slope"] <= got["up"]["high"] and got["flat"]["direction"] == "none"


def test_orfs_of_all_frames_without_a_shuffle(spark):
    """Against a plain loop: random texts, other letters, a null and texts that are too short."""
    r = np.random.default_rng(5)
    texts = ["".join(r.choice(list("ACGT"), n)) for n in (900, 700, 401, 2, 0)] + ["".join(r.choice(list("ACGTNaé𝄞"), 600, p=[0.24] * 4 + [0.01] * 4))]
    found = sequences.orfs(spark.createDataFrame([*enumerate(texts), (9, None)], "id long, s string"), "s", "id", 5)
    want = set()
    for key, text in enumerate(texts):
        for frame in (1, 2, 3, -1, -2, -3):
            strand, first = text if frame > 0 else text.translate(str.maketrans("ACGT", "TGCA"))[::-1], None
            for i in range(abs(frame) - 1, len(strand) - 2, 3):
                codon = strand[i : i + 3]
                if codon in sequences.STOPS:
                    if first is not None and (i - first) // 3 >= 5:
                        want.add((key, frame, *((first + 1, i + 3) if frame > 0 else (len(text) - i - 2, len(text) - first)), (i - first) // 3))
                    first = None
                elif codon in sequences.STARTS and first is None:
                    first = i
    assert {tuple(x) for x in found.collect()} == want and len(want) > 20
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_normality_leaves_large_groups_where_they_are(spark):
    """Groups of 2, 3, 5 000 and 5 001 values and without a name; a group that is not judged is not shuffled by its name."""
    r = np.random.default_rng(8)
    rows = [(g, float(r.normal())) for g, n in (("two", 2), ("three", 3), ("whole", 5000), ("large", 5001), (None, 9)) for _ in range(n)]
    found = compare.normality(spark.createDataFrame(rows, "g string, v double"), "g", "v")
    assert {x["group_label"] for x in found.collect()} == {"three", "whole"}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_compare_composition(spark):
    rows = [(f"s{i}", f"t{j}", (20 + i) if (j < 3) == (i < 5) else 1 + i % 3) for i in range(10) for j in range(6)]
    counts = spark.createDataFrame(rows, "sample string, taxon string, n int")
    labels = spark.createDataFrame([(f"s{i}", "left" if i < 5 else "right") for i in range(9)], "sample string, level string")
    found = compare.compare_composition(counts, labels, replicates=99)
    assert found["permanova"].first()["p_value"] < 0.05 and found["distances"].count() == 45 and found["shannon"].first()["refused"]


def test_lab(spark):
    plates = spark.createDataFrame([("a", 42, 1e5, 0.1), ("a", 5, 1e6, 0.1)], "site string, n int, dilution double, volume double")
    pooled = lab.pooled_titre(plates, "n", "dilution", "volume", ["site"]).first()
    assert pooled["titre"] == pytest.approx(47 / 1.1e-6) and pooled["df"] == 1
    one = lab.titre(plates, "n", "dilution", "volume").orderBy("n").collect()
    assert one[1]["low"] < one[1]["titre"] < one[1]["high"] and [r["quality"] for r in one] == ["too_few", "good"]


def test_resampling(spark):
    rows = resample.indexed(spark.createDataFrame([(i, float(i % 10)) for i in range(40)], "k int, v double"), "k", "v")
    found = resample.bootstrap(rows, "v", 200)
    low, high = resample.bca_interval(rows, found, "v")
    assert low < 4.5 < high and found.count() == 200
    assert resample.bootstrap(rows.where("false"), "v", 5).count() == 0 and resample.jackknife(rows.where("false"), "v", "iqr").count() == 0
    values = [float(i % 10) for i in range(40)]
    for name, whole in (("median", np.median), ("iqr", lambda x: np.quantile(x, 0.75) - np.quantile(x, 0.25)), ("minimum", np.min), ("maximum", np.max)):
        left = {r["idx"]: (r["left_out"], r["influence"]) for r in resample.jackknife(rows, "v", name).collect()}
        want = {i: float(whole(values[:i] + values[i + 1 :])) for i in range(40)}
        assert {i: x[0] for i, x in left.items()} == pytest.approx(want) and all(x[1] == pytest.approx(float(whole(values)) - want[i]) for i, x in left.items())
    assert 0 < resample.monte_carlo_p([1, 2, 3, 4, 5, 30], "normal", 500) < 0.2


def test_trend_and_growth(spark):
    df = spark.createDataFrame([("s", float(t), float(v)) for t, v in enumerate([1, 2, 4, 8, 16, 4, 2, 1])], "s string, t double, v double")
    g = series.growth(df, "t", "v", ["s"]).first()
    assert g["peak_time"] == 4.0 and g["crashes"] and g["doubling_time"] == pytest.approx(1.0)
    line = spark.createDataFrame([("s", float(t), 3.0 * t + 1) for t in range(9)], "s string, t double, v double")
    assert series.theil_sen(line, "t", "v", ["s"]).first()["slope"] == pytest.approx(3.0)
    assert series.mann_kendall(line, "t", "v", ["s"]).first()["tau_b"] == pytest.approx(1.0)


def test_registry_signatures_match_calls(spark):
    df = measured(spark, {"a": [1, 2, 3], "b": [2, 3, 4]})
    with pytest.raises(ValueError, match="justification"):
        registry.call("compare_groups", df=df, group="g", value="v")
    with pytest.raises(ValueError, match="grades"):
        registry.call("codon_usage", grade=6)
    with pytest.raises(ValueError, match="doesn't know"):
        registry.call("describe", df=df, group="g", value="v", colour="red")
    for name in [t.name for t in registry.TOOLS.values() if t.inferential]:
        with pytest.raises(ValueError, match="lacks"):
            registry.call(name, justification="a planned comparison")
    assert registry.call("describe", df=df, group="g", value="v").count() == 2
    assert [t.name for t in registry.tools_for(5)] == ["infer_schema", "validate_table", "dilution_series", "describe"]


def test_stream_of_windows(spark, tmp_path):
    rows = [(dt.datetime(2024, 1, 1, 0, m), "a", float(m)) for m in range(0, 50, 5)] + [(dt.datetime(2024, 1, 1, 5), "a", 1.0)]
    spark.createDataFrame(rows, "ts timestamp, g string, v double").write.parquet(str(tmp_path / "in"))
    stream = ledgers.follow(spark, str(tmp_path / "in"), "ts timestamp, g string, v double")
    q = ledgers.windowed(stream, "ts", "g", "v", "30 minutes").writeStream.outputMode("append").format("memory").queryName("windows").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {r["n"] for r in spark.table("windows").collect()} == {6, 4}
