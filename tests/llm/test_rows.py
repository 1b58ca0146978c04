"""Manifest, whitening and sanitisation against brute force, with defined edge cases."""

import base64
import hashlib
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from skerry.llm import merkle, queries, warc, whitening
from tests.llm.test_texts import EDGES, SCHEMA, invented


def levels_above(leaves):
    found = [leaves]
    while len(found[-1]) > 1:
        found.append([hashlib.sha256("".join(found[-1][i : i + 16]).encode()).hexdigest() for i in range(0, len(found[-1]), 16)])
    return found


def siblings(tree, i):
    path = []
    for level in tree[:-1]:
        run, at = level[i // 16 * 16 : i // 16 * 16 + 16], i % 16
        path.append(("".join(run[:at]), "".join(run[at + 1 :])))
        i //= 16
    return path


def brute_manifest(rows):
    """rows (doc_id, text, lang, source, n_chars) to sorted result rows."""

    def leaf(r, text):
        fields = (r[0], r[3], r[2], r[4], text)
        return hashlib.sha256("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in fields).encode()).hexdigest()

    lower = lambda t: None if t is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    by = {}
    for r in rows:
        by.setdefault(r[3], []).append((r[0], leaf(r, r[1]), leaf(r, lower(r[1]))))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        by[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    trees = {s: levels_above([x[1] for x in by[s]]) for s in names}
    forest, found = levels_above([trees[s][-1][0] for s in names]), []
    for k, s in enumerate(names):
        for i, (doc, own, changed) in enumerate(by[s]):
            path = siblings(trees[s], i) + siblings(forest, k)
            now = changed if doc is not None and zlib.crc32(str(doc).encode()) % 5 == 0 else own
            for a, b in path:
                now = hashlib.sha256((a + now + b).encode()).hexdigest()
            root = forest[-1][0]
            found.append((doc, own, trees[s][-1][0], root, hashlib.sha256("".join(a + b for a, b in path).encode()).hexdigest(), now, now == root))
    return sorted(found, key=repr)


def written(spark, tmp_path, rows, schema=SCHEMA, **extra):
    df = spark.createDataFrame(rows, schema)
    for name, value in extra.items():
        df = df.withColumn(name, F.lit(value))
    df.write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def test_traversal_of_every_size():
    for n in (1, 2, 15, 16, 17, 255, 256, 257, 300, 700, 4095, 4096):
        leaves = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(n)]
        tree = levels_above(leaves)
        for i, path in enumerate(merkle.traverse(leaves, len(tree) - 1)):
            assert path == siblings(tree, i)


@pytest.mark.parametrize("levels", [1, 3])
def test_manifest_equals_brute_force(spark, tmp_path, monkeypatch, levels):
    """One hot source, one of a single row, a null one, and more sources than one run holds; null and repeated ids, equal rows."""
    monkeypatch.setattr(merkle, "BLOCK_LEVELS", levels)
    monkeypatch.setattr(merkle, "BLOCK", 16**levels)
    texts = [*EDGES, "x" * 300_000, *(f"{t.title()} {i}" for i, t in enumerate(invented(600, size=8)))]
    rows = [(i, t, None if i % 7 == 0 else "en", "hot" if i % 2 else f"s{i % 40}", None if i % 11 == 0 else len(t or "")) for i, t in enumerate(texts)]
    rows += [(9000 + i, "A null source", "en", None, 3) for i in range(20)] + [(1, "Only", "en", "é", 4), (5, "Only", "en", "z", 4), (5, "Only", "en", "z", 4)]
    rows += [(None, "No id", "en", "hot", 5), (None, "No id", "en", "hot", 5), (77, "Same id", None, "hot", 7), (77, "Other", None, "hot", 5)] + [(40, "Same Row", "en", "hot", 8)] * 50
    got = queries.op12_merkle(spark, written(spark, tmp_path, rows, pos="clash", tree="clash", digest=1, root=2, id="x"))
    assert sorted(map(tuple, got.collect()), key=repr) == brute_manifest(rows)


def test_manifest_of_few_rows(spark, tmp_path):
    for k, rows in enumerate(([], [(3, "One", "en", "s", 3)], [(3, None, None, None, None), (None, "Ab", "x", "s", 1)])):
        (folder := tmp_path / str(k)).mkdir()
        assert sorted(map(tuple, queries.op12_merkle(spark, written(spark, folder, rows)).collect()), key=repr) == brute_manifest(rows)


def brute_whitening(rows, components=4):
    """rows (vec_id, vector) to {(id, component): (n, deviation, |whitened|, explained)}, by a dense eigendecomposition."""
    whole = [(i, tuple(math.floor(256 * x) for x in v)) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dim = max((len(v) for _, v in whole), default=0)
    whole = [(i, v + (0,) * (dim - len(v))) for i, v in whole]
    fit = sorted({v for _, v in whole})
    if len(fit) < 2:
        return {}
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    z = np.array([[n * x - s for x, s in zip(v, sums)] for v in fit], dtype=float) / n
    values, axes = np.linalg.eigh(z.T @ z / n)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    trace = sum(sum((n * x - s) ** 2 for x, s in zip(v, sums)) for v in fit) / n**3
    return {
        (i, k + 1): (n, sum((n * x - s) ** 2 for x, s in zip(v, sums)), abs(float(np.array([(n * x - s) / n for x, s in zip(v, sums)]) @ axes[:, k]) / values[k] ** 0.5), values[k] / trace)
        for i, v in whole
        for k in range(len(values))
        if values[k] > 1e-12 * trace
    }


def whitened(spark, rows, kind="float", **extra):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
    for name, value in extra.items():
        df = df.withColumn(name, F.lit(value))
    return whitening.whiten(df).collect()


def assert_whitened(got, rows):
    want = brute_whitening(rows)
    assert len(got) >= len(want) and {(r["vec_id"], r["component"]) for r in got} == set(want)
    signs = {}
    for r in got:
        n, deviation, size, share = want[r["vec_id"], r["component"]]
        assert (r["n"], r["deviation"]) == (n, deviation)
        assert abs(r["whitened"]) == pytest.approx(size, rel=1e-6, abs=1e-8)
        assert r["explained"] == pytest.approx(share, rel=1e-9)
        assert r["identity_error"] < 1e-9
        signs.setdefault((r["vec_id"], r["component"]), set()).add(r["whitened"])
    assert all(len(s) == 1 for s in signs.values())


def test_whitening_equals_dense(spark):
    """Copies count once in the fit, equal rows get equal results; odd rows take no part."""
    r = np.random.default_rng(4)
    rows = [(i, [float(np.float32(x)) for x in r.normal(0.3, np.linspace(0.1, 1, 24))]) for i in range(400)]
    rows += [(1000 + i, rows[3][1]) for i in range(300)] + [(None, rows[5][1]), (7, rows[7][1]), (2000, [0.5, -0.25]), (2001, [])]
    rows += [(3000, None), (3001, [float("nan")] * 24), (3002, [float("inf")] + [0.0] * 23), (3003, [None] * 24)]
    got = whitened(spark, rows, n="clash", component=9, x=1)
    assert_whitened(got, rows)


def test_whitening_of_few_rows(spark):
    cases = [], [(1, None)], [(1, [])], [(1, [0.5, 0.5])], [(1, [0.5]), (2, [0.5])], [(1, [0.5]), (2, [0.25])], [(1, [1.0, 2.0, 3.0]), (2, [2.0, 4.0, 6.0]), (3, [5.0, 10.0, 15.0]), (3, [5.0, 10.0, 15.0])]
    for rows in cases:
        assert_whitened(whitened(spark, rows), rows)


def test_whitening_far_from_zero(spark):
    """A large mean costs no digits, and deviations are exact beyond 53 bits."""
    r = np.random.default_rng(9)
    rows = [(i, [1e9 + float(x) for x in r.normal(0, 1000, 3)]) for i in range(300)]
    assert_whitened(whitened(spark, rows, "double"), rows)
    wide = [(i, [float(x) for x in r.normal(0, 1.2e5, 3)]) for i in range(20)]
    assert_whitened(whitened(spark, wide, "double"), wide)
    with pytest.raises(Exception, match="64 bits|62 bits"):
        whitened(spark, [(i, [1e12 * i]) for i in range(9)], "double")
    with pytest.raises(Exception, match="62 bits"):
        whitened(spark, [(1, [1e30]), (2, [0.0])], "double")


def test_lanczos_restarts_and_breakdown():
    r = np.random.default_rng(0)
    turn, _ = np.linalg.qr(r.normal(size=(300, 300)))
    falling, few = 0.9 ** np.arange(300), np.where(np.arange(300) < 5, 9.0 - np.arange(300), 0.0)
    for values, most in ((falling, 384), (few, 384), (few, 60), (np.linspace(2, 1, 300), 80), (np.r_[5.0, 4.0, 3.0, 2.0, np.ones(296)], 70)):
        dense, passes = (turn * values) @ turn.T, []
        got, axes = whitening.lanczos(lambda q: passes.append(1) or dense @ q, 300, 4, max_basis=most)
        assert np.allclose(got, values[:4], rtol=1e-12)
        assert np.allclose(np.abs(np.sum(axes * turn[:, :4], axis=0)), 1, atol=1e-12) and len(passes) < 200
        assert np.linalg.norm(dense @ axes - axes * got, axis=0).max() < 2e-13 * got[0]


def test_listed_words_are_counted_over_all_documents(spark):
    """Words of a language's list come from all words of all its documents, not from a sample that proposes them."""
    from skerry.llm import quality

    texts = [" ".join([*(f"c{j}" for j in range(45)), *(f"r{i}_{j}" for j in range(10)), *(["late"] * (i % 3 == 0))]) for i in range(60)] + ["short late"] * 50
    docs = spark.createDataFrame([(t, lang) for t in texts for lang in ("x", None)], "text string, lang string")
    assert quality.word_lists(docs) == {"x": sorted(f"c{j}" for j in range(45))[:40]}


def test_digests_are_converted_piece_by_piece(spark):
    texts = ["", "a", "é𝄞\n", *(str(i) * i for i in range(300))]
    column = warc.digest(F.col("t"))
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", column.alias("d")).collect()
    assert {r["t"]: r["d"] for r in got} == {t: "sha1:" + base64.b32encode(hashlib.sha1(t.encode()).digest()).decode() for t in texts}
    assert str(column).count("conv(") <= 4 and "sequence" not in str(column)
