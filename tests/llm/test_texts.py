"""Operators on texts: brute force, round trips and defined edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from skerry.llm import bpe, byte_bpe, langid, near_dup, quality, token_counts, token_files, toxicity, warc, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EDGES = [None, "", " ", "\n\t \x0b", "one", "one two three four", "a b c d e", "A B C D E", "İ 漢字 é 😀 x", "x" * 5000, "<|endoftext|> is  no word\r\n", "the " * 3000]


def documents(spark, texts, **extra):
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, SCHEMA)
    for name, value in extra.items():
        df = df.withColumn(name, F.lit(value))
    return df


def invented(n, seed=1, size=120):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice(["an", "er", "th", "on", "in", "re"]) for _ in range(r.randint(1, 4))) for _ in range(400)]
    return [" ".join(r.choice(vocabulary) for _ in range(r.randint(size // 2, size))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(byte_bpe.resolve(None))


def test_bpe_equals_library(spark, library):
    got = {r["doc_id"]: r for r in bpe.encode(documents(spark, EDGES, ids="clash", n_tokens=1), outputs=("ids", "decoded", "n_tokens", "ids_sha256", "decoded_sha256")).collect()}
    for i, text in enumerate(EDGES):
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        r = got[i]
        assert (r["ids"], r["decoded"], r["n_tokens"]) == (ids, decoded, len(ids))
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()


def test_bpe_random_strings(library):
    r, parts = random.Random(3), [" ", "  ", "\n", "\t", "a", "the", "é", "漢", "😀", "'s", "12", "!", "<|endoftext|>", " ", "\x85", "\r\n", "é", "　", "\x1c"]
    own, by_library = byte_bpe.load(byte_bpe.resolve(None)), byte_bpe.load_library(byte_bpe.resolve(None))
    for _ in range(1500):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 10)))
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(own.encode(text), "<u4").tolist() == ids == np.frombuffer(by_library.encode(text), "<u4").tolist()
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_bpe_decode_and_empty(spark):
    rows = bpe.encode(documents(spark, ["to be", None]), outputs=("ids",))
    assert sorted(r["decoded"] for r in bpe.decode(rows).collect()) == ["", "to be"]
    assert bpe.encode(documents(spark, []).limit(0)).count() == 0


def test_merge_table_is_bounded():
    table = byte_bpe.Pieces(len, limit=3)
    assert [table[k] for k in ("a", "bb", "a", "ccc", "dddd", "eeeee", "a", "bb")] == [1, 2, 1, 3, 4, 5, 1, 2]
    assert len(table) <= 3 and len(table.recent) <= 3


def test_token_files(spark, library, tmp_path):
    texts = EDGES + invented(40)
    docs = documents(spark, texts, start=5, n_tokens=1).repartition(3)
    got = {r["doc_id"]: r for r in token_files.round_trip(docs).collect()}
    start = 0
    for i, text in enumerate(texts):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    manifest = token_files.write(docs, str(tmp_path / "files"), length=16).collect()
    file = token_files.SequenceFile(f"{manifest[0]['file']}.arrow")
    ids, mask = file.sequence(0)
    assert len(ids) == 16 and mask.all()
    assert token_files.round_trip(documents(spark, []).limit(0)).count() == 0


def test_token_counts_equal_brute_force(spark):
    scores = token_counts.zipf_scores(token_counts.read_pieces(byte_bpe.resolve(None, token_counts.FILE)))
    longest, byte = max(map(len, scores)), min(scores.values()) - token_counts.BYTE_PENALTY

    def brute(word):
        best = [(0.0, 0)]
        for i in range(1, len(word) + 1):
            size = len(word[i - 1].encode())
            options = [(best[i - 1][0] + size * byte, best[i - 1][1] - size)]
            options += [(best[j][0] + scores[word[j:i]], best[j][1] - 1) for j in range(max(0, i - longest), i) if word[j:i] in scores]
            best.append(max(options))
        return -best[-1][1]

    texts = EDGES[:9] + invented(20)
    got = {r["doc_id"]: (r["n_tokens"], r["n_pretokens"]) for r in token_counts.count_tokens(documents(spark, texts)).collect()}
    for i, text in enumerate(texts):
        found = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        assert got[i] == (sum(brute(token_counts.MARK + w) for w in found), len(found))


def test_trie_rebuild_changes_nothing(monkeypatch):
    trie = token_counts.Trie(token_counts.zipf_scores(["▁", "a", "b", "ab", "▁ab", "abc"]))
    before = [trie.count(w) for w in ("▁abab", "▁abc", "▁zz", "")]
    monkeypatch.setattr(token_counts, "MAX_NODES", 1)
    assert [trie.count(w) for w in ("▁abab", "▁abc", "▁zz", "")] == before


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(texts):
    sets, up = {i: shingles(t) for i, t in enumerate(texts)}, {i: i for i in range(len(texts))}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in sets:
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), top(i)) for i in sets}


def test_near_duplicates_equal_brute_force(spark):
    r, base = random.Random(5), invented(60, size=160)
    texts = EDGES + base
    for k, t in enumerate(base[:30]):  # copies with more and more changes, on both sides of the limit
        for changes in range(0, 12, 2):
            w = t.split(" ")
            for _ in range(changes):
                w[r.randrange(len(w))] = f"changed{k}{changes}"
            texts.append(" ".join(w))
    texts += [base[0].upper()] * 3
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"], x["kept"]) for x in near_dup.near_duplicates(documents(spark, texts, component_id=1, kept="x").repartition(5)).collect()}
    want = brute_components(texts)
    assert got == {i: (n, c, c == i) for i, (n, c) in want.items()}


def test_large_group_of_near_copies(spark):
    r, t = random.Random(9), invented(1, seed=8, size=300)[0].split(" ")
    texts = []
    for i in range(150):
        w = list(t)
        for _ in range(r.randint(0, 9)):
            w[r.randrange(len(w))] = f"w{i}"
        texts.append(" ".join(w))
    got = {x["doc_id"]: x["component_id"] for x in near_dup.near_duplicates(documents(spark, texts)).collect()}
    assert got == {i: c for i, (_, c) in brute_components(texts).items()}


def test_near_duplicates_in_a_star_of_edits(spark, monkeypatch):
    """Edits that are like their hub alone, a hub that is not the least of them, and edits just too far from it."""
    r = random.Random(11)
    hub = [f"w{r.randrange(10**9)}" for _ in range(354)]

    def edit(changes):
        w = list(hub)
        for i in r.sample(range(6, 342, 6), changes):
            w[i] = f"x{r.randrange(10**9)}"
        return " ".join(w)

    texts = [edit(9) for _ in range(1200)] + [edit(11) for _ in range(60)] + [" ".join(hub)]
    sets = words.shingle_sets([t.encode() for t in texts])
    values, codes = np.unique(np.concatenate(sets), return_inverse=True)
    sizes = np.array([len(s) for s in sets])
    at = np.concatenate(([0], np.cumsum(sizes)))
    want = list(range(len(texts)))
    for i in range(len(texts)):
        common = np.add.reduceat(np.isin(np.arange(len(values)), codes[at[i] : at[i + 1]])[codes].astype(int), at[:-1])
        for j in np.flatnonzero(100 * common >= 75 * (sizes[i] + sizes - common)):
            if want[i] != want[j]:
                low, high = sorted((want[i], want[j]))
                want = [low if c == high else c for c in want]
    assert want[-1] == 0 and len(set(want)) == 61
    for rows in (4096, 100):
        monkeypatch.setattr(near_dup, "BLOCK_ROWS", rows, raising=False)
        got = {x["doc_id"]: x["component_id"] for x in near_dup.near_duplicates(documents(spark, texts)).collect()}
        assert got == dict(enumerate(want))


def test_near_duplicates_odd_rows(spark):
    rows = [(None, "a b c d e f", "en", "s", 1), (7, "a b c d e f", "en", "s", 1), (7, "a b c d e f", "en", "s", 1), (3, None, None, None, None)]
    got = sorted(((x["doc_id"], x["component_id"], x["kept"]) for x in near_dup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == sorted([(None, None, True), (7, 7, True), (7, 7, True), (3, 3, True)], key=str)
    assert near_dup.near_duplicates(documents(spark, []).limit(0)).count() == 0


def brute_quality(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    seen = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if seen[x] > 1 for k in range(3)}
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), failed


def test_quality_base_equals_brute_force(spark):
    texts = EDGES[:11] + ["a b c " * 30, "x y\nx y\n\nx y\n z", "a b c d a b c d", "|# a $ b *" * 20, "the of and\n" * 60] + invented(12)
    rows = quality.judge(documents(spark, texts, n_words="clash", kept=1)).collect()
    got = {r["doc_id"]: (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in rows}
    assert got == {i: brute_quality(t) for i, t in enumerate(texts)}
    assert all(not r["kept"] for r in rows if r["base_failed"])


def test_quality_distance_rejects_odd_characters(spark):
    common, other = "the of and to in a is that for it as was with be by on not he his but".split(), [w for t in invented(8) for w in t.split()]
    r = random.Random(2)
    clean = [" ".join(r.choice(common) if r.random() < 0.4 else r.choice(other) for _ in range(300)) for _ in range(30)]
    junk = [" ".join(f"{r.choice(other)}&&&%%%" for _ in range(300)) for _ in range(3)] + [" ".join(r.choice(other).upper() + "!!" for _ in range(300))]
    got = {x["doc_id"]: x["kept"] for x in quality.judge(documents(spark, clean + junk)).collect()}
    assert all(got[i] for i in range(30)) and not any(got[i] for i in range(30, 34))


def test_quality_of_any_language(spark):
    """Clean documents in scripts beyond the four languages stay; junk under the same labels goes."""
    r = random.Random(9)
    scripts = {"ru": "абвгдежзиклмнопрстуф", "zh": "的一是不了人我在有他这中大来上国和说们时", "en": "abcdefghijklmnopqrst"}
    rows, clean = [], set()
    for lang, letters in scripts.items():
        make = lambda k: ["".join(r.choice(letters) for _ in range(r.randint(2, 5))) for _ in range(k)]  # noqa: B023, E731
        common, other = make(20), make(300)
        for k in range(31):
            w = [r.choice(common) if r.random() < 0.4 else r.choice(other) for _ in range(300)]
            if k < 30:
                clean.add(len(rows))
            else:
                w = [f"{x}&&&%%%###" for x in w]
            rows.append((len(rows), " ".join(w), lang, "s", 1))
    clean.add(len(rows))
    rows += [(len(rows), rows[0][1], None, "s", 1), (len(rows) + 1, rows[30][1], " ", "s", 1), (len(rows) + 2, rows[30][1][:100], "few", "s", 1)]
    got = {x["doc_id"]: x for x in quality.judge(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {i for i, x in got.items() if x["kept"]} == clean and len(got) == len(rows)
    assert {got[i]["nearest"] for i in range(30)} == {"ru"} and got[93]["nearest"] == "ru"


def brute_distances(rows):
    """Distances to the nearest reference and the verdict, from plain counters."""
    classes = [str.islower, str.isupper, str.isdecimal, lambda c: c in ".,;:!?'\"()-", lambda c: c in "#*$%&|<>"]

    def chars(t):
        n = [sum(f(c) for c in t) for f in classes] + [sum(c in " \t\n\x0b\x0c\r" for c in t)]
        return [*n, len(t) - sum(n)]

    words = {i: [w for w in re.split(r"[ \t\n\x0b\x0c\r]", t or "") if w] for i, t, _ in rows}
    failed = {i: len(w) < 50 or 100 * brute_quality(t)[4] > 50 * len(w) for (i, t, _), w in zip(rows, words.values())}
    held, lists, reference = {}, {}, {}
    for i, _, lang in rows:
        if lang and len(words[i]) >= 50:
            held.setdefault(lang, Counter()).update(set(words[i]))
    for lang, counts in held.items():
        lists[lang] = sorted(counts, key=lambda w: (-counts[w], w))[: quality.LISTED]
    for lang, listed in lists.items():
        own = [(i, t) for i, t, k in rows if k == lang and not failed[i]]
        if own:
            n = [sum(x) for x in zip(*(chars(t) for _, t in own))]
            total, c = sum(len(words[i]) for i, _ in own), Counter(w for i, _ in own for w in words[i])
            reference[lang] = [x / sum(n) for x in n], {w: c[w] / total for w in listed if c[w]}

    def distance(p, q):
        part = lambda x, y: x * math.log2(2 * x / (x + y)) / 2 if x > 0 else 0.0
        return math.sqrt(max(0.0, sum(part(x, y) + part(y, x) for x, y in zip(p, q))))

    found = {}
    for i, t, _ in rows:
        t, w = t or "", words[i]
        best = None
        for lang in sorted(reference):
            shares, listed = reference[lang]
            c = Counter(w)
            p, q = [c[x] / max(1, len(w)) for x in listed], list(listed.values())
            d = distance([x / max(1, len(t)) for x in chars(t)], shares), distance([*p, max(0, 1 - sum(p))], [*q, max(0, 1 - sum(q))])
            best = min(best or (9, "", ()), (sum(d), lang, d))
        far = (len(t) >= quality.MIN_CHARS and best[2][0] > quality.MAX_CHAR_DISTANCE) or (len(w) >= quality.MIN_WORDS and best[2][1] > quality.MAX_WORD_DISTANCE)
        found[i] = (best[1], *best[2], not failed[i] and not far)
    return found


def test_quality_distances_equal_brute_force(spark):
    r, rows = random.Random(12), []
    for lang, letters in (("xx", "abcdefg"), ("yy", "ghijklmnop"), (None, "abcdxyz")):
        common = ["".join(r.choice(letters) for _ in range(r.randint(1, 3))) for _ in range(12)]
        for k in range(12):
            w = [r.choice(common) if r.random() < 0.5 else "".join(r.choice(letters) for _ in range(r.randint(2, 7))) for _ in range(r.choice([20, 60, 160, 400]))]
            w = [x.upper() + "!!" for x in w] if k == 10 else [f"{x}##%%&&" for x in w] if k == 11 else [x.title() + "." if r.random() < 0.1 else x for x in w]
            rows.append((len(rows), " ".join(w), lang))
    rows += [(900, None, "xx"), (901, "", "yy"), (902, rows[3][1], "xx"), (903, rows[3][1], "xx"), (904, "ä 1 2 " * 20_000, None)]
    got = {x["doc_id"]: x for x in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    expected = brute_distances(rows)
    assert got.keys() == expected.keys()
    for i, (nearest, chars, common, kept) in expected.items():
        assert (got[i]["nearest"], got[i]["kept"]) == (nearest, kept), i
        assert abs(got[i]["char_distance"] - chars) < 1e-9 and abs(got[i]["word_distance"] - common) < 1e-9, i
    assert {k for *_, k in expected.values()} == {True, False}


def test_quality_without_references(spark):
    docs = documents(spark, invented(3)).drop("lang")
    assert quality.judge(docs).where("kept").count() == 3 and quality.judge(docs.limit(0)).count() == 0


def test_toxicity_learns_and_scores_whole_texts(spark):
    r, plain = random.Random(4), invented(400, size=100)
    texts, labels = [], []
    for i, t in enumerate(plain):
        w = t.split(" ")
        toxic = i % 4 == 0
        for _ in range(5 * toxic):
            w.insert(r.randrange(len(w)), r.choice(["zogscum", "zoglout", "zogtrash"]))
        texts.append(" ".join(w))
        labels.append((i, int(toxic)))
    docs = documents(spark, texts + [None, ""], score="clash")
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, known)
    got = {x["doc_id"]: x["score"] for x in toxicity.score(docs, model).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.5) == (i % 4 == 0) for i in held]) > 0.97
    assert len(got) == 402 and 0 <= got[400] <= 0.5 and got[400] == got[401]
    assert toxicity.fit(docs, known.where("toxic = 0")) is None
    assert {x["score"] for x in toxicity.score(docs, None).collect()} == {0.0}


def test_toxicity_labels_of_held_out_rows_change_nothing(spark):
    texts = invented(60)
    docs = documents(spark, texts)
    known = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    flipped = known.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.fit(docs, k) for k in (known, flipped))
    assert (a.weights == b.weights).all() and (a.language.mass == b.language.mass).all() and (a.language.words == b.language.words).all()


def labelled_rows(n=300):
    r, rows = random.Random(4), []
    for i, t in enumerate(invented(n, size=60)):
        w = t.split(" ")
        for _ in range(4 * (i % 4 == 0)):
            w.insert(r.randrange(len(w)), r.choice(["zogscum", "zoglout", "Zogtrash", "d\u00e4mlich"]))
        rows.append((i, " ".join(w), int(i % 4 == 0)))
    return rows


def brute_kneser_ney(rows):
    """Probabilities of every expression under either class, from dictionaries of histories."""
    had, d, stem = {}, toxicity.DISCOUNT, lambda w: w.decode()[:4]
    for i, text, label in rows:
        if zlib.crc32(str(i).encode()) % 5 in (1, 2, 3):
            before = b""
            for w in re.findall(rb"[a-z\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode())):
                had.setdefault(w, set()).add((before, label))
                before = stem(w)
    n = {w: ([len({b for b, x in s if x == c}) for c in (0, 1)], len({b for b, _ in s})) for w, s in had.items()}
    stems = {}
    for w, (own, shared) in n.items():
        t = stems.setdefault(stem(w), [[0, 0], 0])
        t[0], t[1] = [a + b for a, b in zip(t[0], own)], t[1] + shared
    total, everything = [sum(own[c] for own, _ in n.values()) for c in (0, 1)], sum(s for _, s in n.values())
    left = [sum(min(own[c], d) for own, _ in n.values()) / total[c] for c in (0, 1)]
    stem_left = [sum(min(own[c], d) for own, _ in stems.values()) / total[c] for c in (0, 1)]

    def r(s, c):
        own, shared = stems.get(s, ([0, 0], 1))
        return max(own[c] - d, 0) / total[c] + stem_left[c] * shared / (everything + 1)

    def p(w, c):
        own, shared = n.get(w, ([0, 0], 1))
        return max(own[c] - d, 0) / total[c] + left[c] * r(stem(w), c) * shared / stems.get(stem(w), (0, 1))[1]

    return n, p, r


def test_toxicity_equals_brute_force_kneser_ney(spark, monkeypatch):
    rows = labelled_rows()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(700, "zogscum anner unheard zogmore"), (701, "")], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(i, x) for i, _, x in rows], "doc_id long, toxic int"))
    seen, p, r = brute_kneser_ney(rows)
    for c in (0, 1):  # all that was seen, and one expression that was not
        everything = sum(shared for _, shared in seen.values())
        assert abs(sum(p(w, c) for w in seen) + float(model.language.left[c] * model.language.stem_left[c]) / (everything + 1) - 1) < 1e-9

    def difference(text):
        found = re.findall(rb"[a-z\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode()))
        return sum(math.log(1 - toxicity.TOXIC_SHARE + toxicity.TOXIC_SHARE * p(w, 1) / p(w, 0)) for w in found) / max(1, len(found))

    expected = {x["doc_id"]: difference(x["text"]) for x in docs.collect()}
    got = {x["doc_id"]: x["difference"] for x in toxicity.differences(docs, model.tables, model.language, "doc_id").collect()}
    assert got.keys() == expected.keys() and all(abs(got[i] - expected[i]) < 1e-9 for i in expected)
    # without the model in one piece: all expressions common, some, and none
    for most in (toxicity.MAX_BROADCAST_WORDS, 60, -1):
        monkeypatch.setattr(toxicity, "MAX_BROADCAST_WORDS", most)
        known = toxicity.evidence(docs, model.tables).collect()
        common = sum(x["texts"] * most >= sum(y["texts"] for y in known) for x in known)
        assert 0 < common < len(known) if most == 60 else common == (len(known) if most > 0 else 0)
        joined = {x["doc_id"]: x["difference"] for x in toxicity.differences(docs, model.tables, None, "doc_id").collect()}
        assert joined.keys() == expected.keys() and all(abs(joined[i] - expected[i]) < 1e-9 for i in expected)
    monkeypatch.setattr(toxicity, "MAX_BROADCAST_WORDS", -1)
    large = toxicity.fit(docs, spark.createDataFrame([(i, x) for i, _, x in rows], "doc_id long, toxic int"))
    assert large.language is None and np.allclose(large.weights, model.weights)


def test_toxicity_odd_rows(spark):
    rows = labelled_rows(120)
    labels = spark.createDataFrame([(i, x) for i, _, x in rows] + [(None, 1), (5, None)], "doc_id long, toxic int").withColumn("text", F.lit("clash"))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(None, "zogscum zoglout"), (None, None), (800, "an th " * 50_000 + "zogscum"), (801, "12 34 !"), (0, rows[0][1])], "doc_id long, text string").withColumn("label", F.lit(1))
    model = toxicity.fit(docs, labels)
    got = [(x["doc_id"], x["score"]) for x in toxicity.score(docs, model).collect()]
    assert len(got) == 125 and all(0 <= s <= 1 for _, s in got)
    assert len({s for i, s in got if i == 0}) == 1 and sum(i == 0 for i, _ in got) == 2
    by = dict(x for x in got if x[0] is not None)
    assert by[801] == next(s for i, s in got if i is None and s == by[801]) and by[800] < 0.5
    assert toxicity.score(docs.limit(0), model).count() == 0 and toxicity.fit(docs.limit(0), labels) is None


def test_language(spark):
    r = random.Random(6)
    kinds = {"xx": "an er th on in", "yy": "au eu qué ñi lo", "zz": "sch ung keit ß über"}
    rows = [(i, " ".join("".join(r.choice(kinds[k].split()) for _ in range(3)) for _ in range(r.randint(5, 300))), k, "s", 1) for i, k in enumerate(list(kinds) * 60)]
    rows += [(900, None, "xx", "s", 1), (901, "12 34 !", "xx", "s", 1), (902, "", None, "s", 1), (903, "anerth", None, "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit("clash"))
    got = {x["doc_id"]: x for x in langid.predict(docs, langid.fit(docs, steps=120)).collect()}
    held = [(i, k) for i, _, k, *_ in rows[:180] if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([got[i]["lang_pred"] == k for i, k in held]) > 0.95
    assert [got[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3 and got[903]["lang_pred"] in kinds
    assert langid.fit(docs.limit(0)) is None and langid.predict(docs.limit(0), None).count() == 0


def test_language_letters_and_odd_rows(spark):
    """Letters are category L: digits, fractions and Roman numerals of Unicode are none; ids may repeat, texts be long."""
    rows = [(i, ("an er th " if i % 2 else "qué ñi lo ") * r, "xx" if i % 2 else "yy") for i, r in enumerate([3, 40] * 30)]
    marks = ["² ½ 12", "Ⅷ", "٣", "①", "_", "漢", "İ"]
    rows += [(500 + i, t, "xx") for i, t in enumerate(marks)] + [(None, "an er", "xx"), (0, rows[0][1], "yy"), (700, "qué ñi " * 100_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("window", F.lit("clash"))
    got = [(x["doc_id"], x["lang_pred"], x["score"]) for x in langid.predict(docs, langid.fit(docs, steps=120)).collect()]
    by = {i: (k, s) for i, k, s in got}
    assert len(got) == len(rows) and [by[500 + i][0] == "und" for i in range(len(marks))] == [True] * 5 + [False] * 2
    assert by[500] == ("und", 0.0) and by[700][0] == "yy" and len({x for x in got if x[0] == 0}) == 1


def test_windows_cover_every_byte():
    for size in (0, 1, 255, 256, 257, 253 * 3 + 3, 2000):
        raw = bytes(i % 26 + 97 for i in range(size))
        x, owner, weight = langid.windows([raw, b"q"])
        mine = x[owner == 0]
        assert bytes(mine[0]) + b"".join(bytes(w[langid.OVERLAP :]) for w in mine[1:]) == raw.ljust(256 + 253 * (len(mine) - 1), b" ")


def test_pair_tables_equal_plain_convolution():
    net, x = langid.ByteCNN.new(["a", "b"]), np.random.default_rng(1).integers(0, 256, (5, 256)).astype(np.uint8)
    pooled = np.concatenate([np.maximum(net._responses(x, k).max(axis=1) + net.bias[k], 0) for k in range(3)], axis=1)
    z = np.exp(pooled @ net.out + net.out_bias)
    assert np.allclose(net.probabilities(x), z / z.sum(axis=1, keepdims=True), atol=1e-5)


def test_word_hashes_are_position_independent():
    a, at = words.word_hashes([b"Alpha beta", b"  beta\talpha \n"])
    assert list(at) == [0, 2, 4] and a[0] == a[3] and a[1] == a[2] and a[0] != a[1]


def test_warc_records(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a.example/", "<html lang=\"en\"><title>A &amp; B</title><script>x('</p>')</script><p>One<br>two &lt;3</p><!-- no --></html>"), (2, None, None)], "page_id long, url string, html string").withColumn("block", F.lit("clash"))
    made = warc.derivatives(warc.responses(pages), "page_id")
    rows = {(r["page_id"], r["record_type"]): r for r in made.collect()}
    assert rows[1, "conversion"]["block"] == "A & B\nOne\ntwo <3" and "title: A &amp; B" in rows[1, "metadata"]["block"] and "source-Content-Type: text/html" in rows[1, "metadata"]["block"]
    assert rows[1, "conversion"]["refers_to"] == rows[1, "metadata"]["refers_to"] != rows[2, "metadata"]["refers_to"]
    import base64

    block = rows[1, "conversion"]["block"].encode()
    assert rows[1, "conversion"]["block_digest"] == "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode() and rows[1, "conversion"]["content_length"] == len(block)
    assert rows[2, "conversion"]["block"] == ""
    warc.write(made, str(tmp_path / "warc"))
    back = {r["record_id"]: r for r in warc.read(spark, str(tmp_path / "warc")).collect()}
    for r in rows.values():
        assert back[r["record_id"]]["block"] == r["block"] and back[r["record_id"]]["refers_to"] == r["refers_to"] and back[r["record_id"]]["target_uri"] == r["target_uri"]


def test_near_duplicates_among_texts_with_a_common_frame(spark):
    """Unrelated texts share most of their words (similarity 0.70); planted pairs are just above the threshold."""
    r = random.Random(5)
    frame = [f"f{i}" for i in range(330)]
    texts = []
    for i in range(700):
        own = [f"o{i}x{k}" for k in range(70)]
        texts.append(" ".join(frame + own))
        if i % 10 == 0:  # its own words but for the last 18: 0.776
            texts.append(" ".join(frame + own[:52] + [f"p{i}x{k}" for k in range(18)]))
    r.shuffle(texts)
    truth = {i: c for i, (_, c) in brute_components(texts).items()}
    forest_pairs = {x["doc_id"]: x["component_id"] for x in near_dup.near_duplicates(documents(spark, texts)).collect()}
    assert forest_pairs == truth and sum(i != c for i, c in truth.items()) == 70


def test_near_duplicates_send_little_to_the_driver(spark, monkeypatch):
    """Bucket counts come as a byte each, and the keys that Spark samples for ranges are numbers."""
    kind, keys = type(spark.range(0)), []
    plain = kind.repartitionByRange

    def ranged(self, *by):
        keys.append([t for _, t in self.select(*(c for c in by if not isinstance(c, int))).dtypes])
        return plain(self, *by)

    def whole(self):
        raise AssertionError("a table goes to the driver")

    monkeypatch.setattr(kind, "repartitionByRange", ranged)
    monkeypatch.setattr(kind, "toPandas", whole)
    r = random.Random(8)
    frame = [f"f{i}" for i in range(330)]
    texts = [" ".join(frame + [f"o{i}x{k}" for k in range(70)]) for i in range(160)]
    texts += [" ".join(frame + [f"o{i}x{k}" for k in range(52)] + [f"p{i}x{k}" for k in range(18)]) for i in range(0, 160, 10)]
    r.shuffle(texts)
    got = {x["doc_id"]: x["component_id"] for x in near_dup.near_duplicates(documents(spark, texts)).collect()}
    assert got == {i: c for i, (_, c) in brute_components(texts).items()}
    assert keys and all(t == "bigint" for by in keys for t in by)


def test_loads_are_levels_in_the_order_of_counts(spark):
    sets = [np.arange(1, 1 + 3 * k, dtype="<u8") for k in range(1, 40)]
    load = near_dup.loads(spark.createDataFrame([(bytearray(s.tobytes()),) for s in sets], "set binary").repartition(3))
    counts = np.bincount(near_dup._bucket(np.concatenate(sets)), minlength=1 << near_dup.BUCKET_BITS)
    assert load.dtype == np.uint8 and len(load) == 1 << near_dup.BUCKET_BITS
    assert ((load > 0) == (counts > 0)).all() and (np.diff(load[np.argsort(counts, kind="stable")].astype(int)) >= 0).all()
