"""Personal data: base spans against the plain patterns, disclosing terms and sanitised texts against brute force."""

import hashlib
import math
import random
import re
import time
from collections import Counter, defaultdict

import pytest
import regex
from pyspark.sql import functions as F

from skerry.llm import privacy, queries
from tests.llm.test_rows import written
from tests.llm.test_texts import EDGES, invented

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def checks(kind, match):
    digits = [int(c) for c in match if c.isdigit()]
    if kind == "ip":
        return all(int(x) <= 255 for x in match.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(reversed(digits))) % 10 == 0
    return kind != "phone" or 8 <= len(digits) <= 15


def plain_spans(text):
    return {k: [m.span() for m in re.finditer(p, text) if checks(k, m.group())] for k, p in PLAIN.items()}


def one_form(kind, match):
    return f"{kind}:" + (match.lower() if kind == "email" else match if kind == "ip" else re.sub("[^0-9]", "", match))


def brute_actions(texts):
    """{term: removed} of all terms that disclose."""
    n_entity, n_term, pairs = Counter(), Counter(), defaultdict(Counter)
    for text in texts:
        seen, entities = {}, set()
        n_term.update({w.lower() for w in regex.findall(r"\p{L}{3,}", text)})
        for kind, pattern in PLAIN.items():
            matches = list(re.finditer(pattern, text))
            # the operator's card pattern sees whole chains of 16 to 19 digits only
            matches = [m for m in matches if kind != "card" or 16 <= len(re.sub("[^0-9]", "", m.group())) <= 19]
            for i, m in enumerate(matches):
                if not checks(kind, m.group()):
                    continue
                before = text[matches[i - 1].end() if i else 0 : m.start()]
                after = text[m.end() : matches[i + 1].start() if i + 1 < len(matches) else len(text)]
                left = regex.sub(r"^\p{L}+", "", before[-privacy.WINDOW :]) if len(before) > privacy.WINDOW else before
                right = regex.sub(r"\p{L}+$", "", after[: privacy.WINDOW]) if len(after) > privacy.WINDOW else after
                e = one_form(kind, m.group())
                entities.add(e)
                words = [w.lower() for w in regex.split(r"[^\p{L}]+", left + " " + right) if w]
                for j, w in enumerate(words):
                    if len(w) >= 3:
                        around = f"{words[j - 1] if j else ''} {words[j + 1] if j + 1 < len(words) else ''}"
                        seen[e, w] = min(seen.get((e, w), (around,)), (around,))
        n_entity.update(entities)
        for (e, w), (around,) in seen.items():
            pairs[e, w][around] += 1
    hidden = {}
    for (e, w), near in pairs.items():
        both = sum(near.values())
        bits = math.log2(max(n_term[w], both) / both)
        if both >= privacy.LEAST_EVIDENCE * max(near.values()) and math.log2(len(texts) / n_entity[e]) >= privacy.LEAST_IC and bits <= privacy.GENERALISE_BITS:
            hidden[w] = min(hidden.get(w, 9), bits)
    return {w: b <= privacy.REMOVE_BITS for w, b in hidden.items()}


def brute_sanitised(text, actions):
    found = plain_spans(text)
    taken = [s for spans in found.values() for s in spans]
    found["term"] = [m.span() for m in regex.finditer(r"\p{L}{3,}", text) if m.group().lower() in actions and not any(a < m.end() and m.start() < b for a, b in taken)]
    for kind, pattern in PLAIN.items():
        if found[kind]:
            text = re.sub(pattern, lambda m, k=kind: f"[{k}]" if checks(k, m.group()) else m.group(), text)
    swap = lambda m: m.group() if m.group().lower() not in actions else "" if actions[m.group().lower()] else "[name]" if regex.match(r"\p{Lu}", m.group()) else "[word]"
    return found, regex.sub(r"\[(?:email|ip|card|phone)\]|\p{L}{3,}", swap, text)


def run(spark, texts, **extra):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for name, value in extra.items():
        df = df.withColumn(name, F.lit(value))
    return {r["doc_id"]: r for r in privacy.sanitise(df).collect()}


def assert_equal(spark, texts):
    got, plain = run(spark, texts, found="clash", _text=1, sanitised=2), [t or "" for t in texts]
    actions = brute_actions(plain)
    for i, text in enumerate(plain):
        spans, clean = brute_sanitised(text, actions)
        assert {k: [tuple(x) for x in got[i]["found"][k]] for k in spans} == spans, text
        assert got[i]["sanitised"] == clean
    return actions


ODD = [
    "a@b.c_d@e.f g@h..i j@k.l. @m.n o@p", "x.y+z%1@host-1.example.co.uk,q@a.b-c@d.e", "a@b.c@d.e.f", "éa@b.cé 漢字@x.y 😀z@w.v", "1.2.3.4.5.6.7.8.9 01.002.0003.255 1.2.3.256 1.2.3 999.1.1.1.1.1",
    "4111 1111 1111 1111, 4111-1111-1111-1111 4111111111111112 4111 1111  1111 1111", "14111111111111111 4111 1111 1111 1111 5 6", "0000000000000000 0000000000000000000 00000000000000000000", "+1 (555) 010-9999 +12 +1-- +1(2)3.4 +123456789012345 +1234567890123456 ++49 30 1234567",
    "+4111 1111 1111 1111", "+1 555 0100 999 and +1 555 0100 999x a@b.c", "a" * 400 + "@" + "b" * 400 + ".c" * 300, "1." * 500 + "1", "+1" + "-" * 900 + "2345678", "5" * 3000, "@" * 200 + "." * 200,
]


def test_base_spans_of_odd_and_random_texts(spark):
    r = random.Random(5)
    parts = ["a", "B9", "@", "@", ".", ".", "-", "_", "%", "+", "+1", " ", "  ", "(", ")", "0", "7", "255", "256", "4111111111111111", "4111 1111", "1111-1111", "é", "😀", "\n", "x@y.z", "1.2.3.4"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(1, 25))) for _ in range(3000)]
    assert_equal(spark, [*EDGES, *ODD, *texts])


def test_terms_that_disclose(spark):
    """A by-name near one address in many different texts goes everywhere, one that is half as telling is generalised; common words and copies stay."""
    base = [t for t in invented(240, seed=31, size=60)]
    texts = list(base)
    for i in range(12):
        words = base[i].split()
        texts[i] = " ".join([*words[:20], "Zorblatt" if i % 2 else "zorblatt", *words[20:24], "mail", "Rare.Bird@example.org", *words[24:]])
    texts[20] += " Only Zorblatt knows (ZORBLATT, zorblattx)."
    for i in range(30, 50):
        words = base[i].split()
        texts[i] = " ".join([*words[:7], "Quillfeather", *words[7:10], "+1 555 0100 999" if i % 10 else "", *words[10:]])
    for i in range(60, 66):
        texts[i] = base[i][:50] + " Halfword " + base[i][50:]
        if i % 2:
            texts[i] += " then 10.0.0.7 and 10.0.0.7"
    for i in range(70, 78):
        texts[i] = " ".join([*base[i].split()[:9], "Halfling", *base[i].split()[9:12], "10.1.1.7" if i < 74 else ""])
    for i in range(150, 240):
        texts[i] += " mail then and"
    # copies and near copies of one text
    texts += [base[100] + " Copycat lives at 198.51.100.7 by the sea " + base[101] + f" {i % 3}" for i in range(60)]
    actions = assert_equal(spark, texts)
    assert actions.get("zorblatt") is True and actions.get("quillfeather") is True and actions.get("halfling") is False
    assert "copycat" not in actions and not {"mail", "the", "then", "and"} & set(actions)


def test_terms_by_join_and_by_broadcast(spark, monkeypatch):
    """Beyond the bounds of broadcasts the result is the same."""
    monkeypatch.setattr(privacy, "MAX_BROADCAST_TERMS", 0)
    monkeypatch.setattr(privacy, "MAX_BROADCAST_TEXTS", 0)
    test_terms_that_disclose(spark)


def test_protected_only_if_rare(spark):
    """An address in most documents protects nothing."""
    assert brute_actions([f"word{'abc'[i % 3]} Contact office x{i}y desk@example.org {i}" for i in range(40)]) == {}
    assert_equal(spark, [f"word{'abc'[i % 3]} Contact office x{i}y desk@example.org {i}" for i in range(40)])


def test_long_texts_take_linear_time(spark):
    texts = ["a" * 1_000_000, "1" * 1_000_000, "1." * 300_000, "+1" + " " * 1_000_000, "a@" * 300_000, "4111 1111 1111 1111 x " * 5_000, "a@b.c " * 30_000]
    run(spark, ["warm"])
    began = time.perf_counter()
    got = run(spark, texts)
    assert time.perf_counter() - began < 120
    assert len(got[5]["found"]["card"]) == 5_000 and got[5]["found"]["card"][-1]["end"] == 22 * 5_000 - 3 and len(got[6]["found"]["email"]) == 30_000
    assert got[6]["sanitised"] == "[email] " * 30_000


def test_query_of_null_repeated_and_no_rows(spark, tmp_path):
    rows = [(1, None, "en", "s", 1), (None, "x@y.zz", "en", "s", 1), (2, "", None, None, None), (3, "x@y.zz 1.2.3.4", "en", "s", 1), (3, "x@y.zz 1.2.3.4", "en", "s", 1)]
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for k, given in enumerate((rows, [])):
        (folder := tmp_path / str(k)).mkdir()
        got = queries.op11_privacy(spark, written(spark, folder, given, found=1, _email="clash")).collect()
        want = []
        for i, t, *_ in given:
            found = plain_spans(t or "")
            listed = ",".join(f"{kind}:{a}:{b}" for kind, v in found.items() for a, b in v)
            want.append((i, *map(len, found.values()), digest(listed), listed))
        assert sorted((tuple(r)[:7] for r in got), key=repr) == sorted(want, key=repr)
