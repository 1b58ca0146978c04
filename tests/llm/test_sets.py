"""Search, mixing, graphs and the pipeline."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skerry.llm import mixing, mtree
from skerry.llm.graph import contract
from tests.llm.test_texts import SCHEMA, documents, invented


def brute_top(rows, k=5, modulus=50):
    whole = [(i, tuple(math.floor(256 * x) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    found = []
    for q, v in sorted({x for x in whole if x[0] % modulus == 0}):
        scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in whole if i != q)[:k]
        found += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    return sorted(found)


def searched(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in mtree.top_k(df).collect())


def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(mtree, "SHARD_ROWS", 100)
    r = np.random.default_rng(3)
    centres = r.normal(0, 0.3, (5, 8))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 5] + r.normal(0, 0.05, 8)]) for i in range(700)]
    same = rows[0][1]
    rows += [(i, same) for i in range(1000, 1300)] + [(1400, None), (1450, [float("nan")] * 8), (1500, [None] * 8), (1501, [0.5, 0.5]), (None, same), (1600, [])]
    assert searched(spark, rows) == brute_top(rows)


def test_top_k_few_rows(spark):
    for rows in ([], [(0, [0.5])], [(0, [0.5]), (50, [0.25]), (7, [-0.1])], [(1, [0.5])], [(0, [0.0]), (1, [0.0])]):
        assert searched(spark, rows) == brute_top(rows)


def test_top_k_of_large_numbers(spark):
    """Scores beyond 32 and beyond 53 bits are exact; those beyond 64 are refused."""
    rows = [(0, [1e7, 0.0]), (1, [1.0, 0.0]), (2, [-3e6, 5.5]), (50, [2e9 / 256, 3.0]), (3, [2e9 / 256, 3.0 + 1 / 256]), (4, [1e9 / 256, 7.0])]
    df = lambda r: spark.createDataFrame(r, "vec_id long, embedding array<double>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in mtree.top_k(df(rows), query_modulus=50, scale=256).collect())
    assert got == brute_top(rows) and any(s > 2**53 for *_, s in got)
    r = np.random.default_rng(8)
    wide = [(i, [float(x) for x in r.integers(-4_000_000, 4_000_000, 3)]) for i in range(400)]
    got = sorted((x["query_id"], x["rank"], x["vec_id"], x["score"]) for x in mtree.top_k(df(wide)).collect())
    assert got == brute_top(wide)
    with pytest.raises(Exception, match="64 bits"):
        mtree.top_k(df([(0, [1e15]), (1, [1e15])])).collect()
    with pytest.raises(Exception, match="64 bits"):
        mtree.top_k(df([(0, [1e17]), (1, [0.004])])).collect()


def test_top_k_of_repeated_rows(spark, monkeypatch):
    """Equal query rows are one query; its own id is no answer, however often it is there."""
    monkeypatch.setattr(mtree, "SHARD_ROWS", 50)
    monkeypatch.setattr(mtree, "QUERY_BLOCK", 3)
    same = [0.25, -0.5, 0.125]
    rows = [(50, same)] * 8 + [(7, same)] * 3 + [(i, [0.01 * (i % 13), 0.02 * (i % 7), -0.3]) for i in range(100, 400)]
    expected = brute_top(rows)
    assert searched(spark, rows) == expected and [r for r in expected if r[0] == 50][:3] == [(50, 1 + i, 7, 64 * 64 + 128 * 128 + 32 * 32) for i in range(3)]


def test_nodes_hold_true_bounds():
    r = np.random.default_rng(1)
    v = np.floor(256 * r.normal(0, 0.2, (3000, 6))).astype(np.int64)
    top = float((v * v).sum(axis=1).max())
    lifted = np.column_stack([v, np.sqrt(top - (v * v).sum(axis=1))])
    root, inner, held = lifted[0], {}, []
    for _, k, route, radius, to_parent, ids, vectors, from_route in mtree.nodes_of(0, np.arange(3000), v, root, top):
        route = np.frombuffer(route)
        if ids is None:
            inner[k] = (route, radius)
            assert np.isclose(to_parent, np.linalg.norm(route - root))
            continue
        ids, d = np.frombuffer(ids, "<i8"), np.frombuffer(from_route)
        assert np.allclose(np.sqrt(((lifted[ids] - route) ** 2).sum(axis=1)), d) and d.max() <= radius + 1e-9
        assert np.isclose(to_parent, np.linalg.norm(route - inner[k][0])) and np.linalg.norm(lifted[ids] - inner[k][0], axis=1).max() <= inner[k][1] + 1e-9
        held.append(ids)
    assert sorted(np.concatenate(held)) == list(range(3000)) and len(inner) > 1


def mixed(spark, docs, **options):
    return mixing.mix(docs, **options).select("row.doc_id", "source", "tokens", "epoch", "block", "place").collect()


def test_mixture_meets_entropy_and_budget(spark):
    r = random.Random(1)
    rows = [(i, "x" * r.randint(4, 400), "en", "big" if i % 2 else f"s{i % 6}", 1) for i in range(600)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("epoch", F.lit("clash"))
    got = mixed(spark, docs, target_entropy=0.97, block_tokens=1000)
    held = {}
    for x in got:
        held[x["source"]] = held.get(x["source"], 0) + x["tokens"]
    total = sum(held.values())
    entropy = -sum(v / total * math.log(v / total) for v in held.values()) / math.log(len(held))
    budget = sum(math.ceil(len(t) / 4) for _, t, *_ in rows)
    assert abs(entropy - 0.97) < 0.01 and abs(total - budget) < 4 * 100 + 4
    for b in {x["block"] for x in got}:
        assert sorted(x["place"] for x in got if x["block"] == b) == list(range(1, 1 + sum(x["block"] == b for x in got)))
    assert got and mixing.mix(docs, target_entropy=0.97).select("row.*").columns == docs.columns


def test_repetition_limit(spark):
    rows = [(i, "x" * 40, "en", "rare" if i < 5 else "common", 1) for i in range(300)]
    got = mixed(spark, spark.createDataFrame(rows, SCHEMA), target_entropy=None, max_repeats=3.0)
    copies = {}
    for x in got:
        copies[x["doc_id"]] = copies.get(x["doc_id"], 0) + 1
    assert max(copies.values()) == 3 and max(n for i, n in copies.items() if i >= 5) == 1


def test_mixture_odd_rows(spark):
    rows = [(1, None, None, None, None), (2, "", None, "a", 1), (None, "abcd", "en", "a", 4), (3, "abcd", "en", "b", 4), (3, "abcd", "en", "b", 4), (4, "abc", "en", None, 3)]
    got = mixed(spark, spark.createDataFrame(rows, SCHEMA))
    assert {x["doc_id"] for x in got} >= {3} and all(x["epoch"] >= 0 for x in got)
    assert mixing.mix(documents(spark, []).limit(0)).count() == 0
    assert len(mixed(spark, documents(spark, invented(5)).withColumn("source", F.lit("one")))) == 5


def test_mixture_of_null_ids_and_long_texts(spark, monkeypatch):
    """Null ids are drawn by their rows, a long text is taken whole, and the number of ranges changes nothing."""
    rows = [(None, f"{i} " * 40, "en", "a", i) for i in range(200)] + [(i, "y" * 50, "en", "b", 1) for i in range(20)] + [(99, "z " * 200_000, "en", "b", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    pick = lambda: sorted((str(r["doc_id"]), r["n_chars"], r["epoch"], r["block"], r["place"]) for r in mixing.mix(docs, block_tokens=20_000).select("row.doc_id", "row.n_chars", "epoch", "block", "place").collect())
    first = pick()
    assert len({n for i, n, *_ in first if i == "None"}) > 150
    monkeypatch.setattr(mixing, "RANGE_ROWS", 0.01)
    assert pick() == first


def test_contract_long_chain_and_stars(spark):
    edges = [(i, i + 1) for i in range(100)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5, 5), (2001, 2000)]
    random.Random(2).shuffle(edges)
    got = {r["node"]: r["root"] for r in contract(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(101)}, **{1000 + i: 1000 for i in range(50)}, 2000: 2000, 2001: 2000}
    assert contract(spark.createDataFrame([], "a long, b long")) is None


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    common = "the of and to in a is that for it as was with be by on not he his but".split()
    r, other = random.Random(7), [w for t in invented(10) for w in t.split()]
    clean = [" ".join(r.choice(common) if r.random() < 0.4 else r.choice(other) for _ in range(200)) for _ in range(60)]
    texts = clean + [clean[0], clean[1] + " more"] + ["too short", None, " ".join(f"{w}&&&%%%" for w in other[:200])]
    documents(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, step in corpus_pipeline.STAGES:
        docs = step(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "tokens":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept.append({x["doc_id"] for x in docs.select("doc_id").collect()})
    assert kept[0] == kept[1] == set(range(62)) and kept[2] == set(range(60)) and kept[3] <= kept[2] and kept[4] == kept[3]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()


def test_pipeline_of_null_and_repeated_ids(spark, tmp_path):
    """Decisions are a row's own: null ids stay, rows of one id keep their own verdicts, one of equal rows stays."""
    import corpus_pipeline

    r = random.Random(3)
    vocabulary = [w for t in invented(10) for w in t.split()]
    common = "the of and to in a is that for it as was with be by on not he his but".split()
    texts = [" ".join(r.choice(common) if r.random() < 0.4 else r.choice(vocabulary) for _ in range(200)) for _ in range(40)]
    rows = [(i, t, "en", "s", 1, "x") for i, t in enumerate(texts)]
    rows += [(None, " ".join(reversed(texts[6].split())), "en", "s", 1, "x"), (None, texts[1], "en", "s", 1, "x"), (2, "too short", "en", "s", 1, "x"), (3, texts[3], "en", "s", 1, "x"), (4, " ".join(reversed(texts[5].split())), "en", "s", 1, "x")]
    docs = spark.createDataFrame(rows, SCHEMA + ", label string")
    kept = []
    for name, step in corpus_pipeline.STAGES[:3]:
        docs = step(spark, docs, str(tmp_path))
        assert docs.columns == [*(c.split()[0] for c in SCHEMA.split(", ")), "label"]
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept.append(sorted((str(x["doc_id"]), x["text"]) for x in docs.collect()))
    whole = sorted((str(i), t) for i, t, *_ in rows if t != "too short")
    assert kept[0] == kept[1] == whole
    assert kept[2] == sorted({(i, t) for i, t in whole if (i, t) != ("None", texts[1])})


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    documents(spark, []).limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
