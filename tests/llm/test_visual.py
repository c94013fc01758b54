"""Canonical forms: character rules, Viterbi against all paths, and the operator."""

import itertools
import random
import re
import unicodedata

import numpy as np
import pandas as pd
import pytest

from corpuschain.llm import visual


def model(*texts):
    rows = pd.concat(visual.count_trigrams(iter([pd.DataFrame({"t": list(texts)})])))
    return visual.Trigrams(rows["code"].to_numpy(), rows["n"].to_numpy(dtype=float))


CORPUS = ["على بن أبي طالب إلى كتاب في الذي", "في القاضي الذي على كريم", "vol people look lovely", "كتاب كبير هذا هو"] * 20


@pytest.mark.parametrize(
    "given,want",
    [
        ("ｖｏｌ． ５", "vol. 5"), ("a​b­c﻿", "abc"), ("ﺵﺤﯺ", "شحئى"[:2] + unicodedata.normalize("NFKC", "ﯺ")),
        ("إ", "إ"), ("é", "é"), ("بَّ", "بَّ"), ("ىٔ", "ئ"), ("ﬁn", "fin"),
        ("«قال… ½ ™ � ـ ﷺ»", "«قال… ½ ™ � ـ ﷺ»"), ("", ""), ("plain", "plain"), ("a 　b", "a  b"),
    ],
)
def test_plain_form(given, want):
    assert visual.plain_form(given) == want


def test_context_decides():
    m = model(*CORPUS)
    for given, want in [("vоl", "vol"), ("реорlе", "people"), ("کتاب", "كتاب"), ("فی", "في"), ("علی", "على"), ("ھذا", "هذا"), ("Москва", "Москва"), ("۲۰", "٢٠"), ("р.", "p.")]:
        assert visual.canonical(given, m, {}) == want, given


def test_viterbi_is_the_best_path():
    m, rng, table = model(*CORPUS), random.Random(5), visual._symbol_of()

    def score(options, token):
        total, script, a, b = 0.0, "", visual.EDGE, visual.EDGE
        for got, ch in zip(options, token, strict=True):
            s = int(table[ord(got)])
            if s < 0:
                continue
            total += visual.keep(ch, visual.own_scripts(token)) if got == ch else 0.0
            total += visual.UNKNOWN if s == visual.OTHER else float(m.log[a, b, s])
            own = visual._script(got)
            if s == visual.DIGIT:
                own = script or own
            elif script not in ("", own):
                total += visual.SWITCH
            script, a, b = own, b, s
        return total + float(m.log[a, b, visual.EDGE])

    for _ in range(150):
        token = "".join(rng.choice("voоlрpсیکھعلاПж") for _ in range(rng.randrange(1, 6)))
        lattice = [[c, *visual.LOOK_ALIKES.get(c, "")] for c in token]
        best = max(score(p, token) for p in itertools.product(*lattice))
        assert abs(score(visual.search(token, m), token) - best) < 1e-4, token


def test_counting_matches_plain_python():
    texts = ["كتاب ab", None, "", "x1 ", "жab"]
    rows = pd.concat(visual.count_trigrams(iter([pd.DataFrame({"a": texts, "b": texts[::-1]})])))
    assert rows["n"].min() > 0 and not rows["code"].duplicated().any()
    a = 3 + len(visual.ARABIC)
    code = lambda x, y, z: (x * visual.SYMBOLS + y) * visual.SYMBOLS + z
    n = dict(zip(rows["code"], rows["n"], strict=True))
    assert n[code(0, 0, a)] == 2 and n[code(0, a, a + 1)] == 2 and n[code(a, a + 1, 0)] == 4


def test_operator_and_the_filter_before_it(spark):
    rng = random.Random(9)
    odd = ["", "‌", " ", "ｘ", "ﺏ", "ی", "о", "بَّ", "بَّ", "أ", "é", "…", "«", "�", "۵", "\t", "ـ", "ı"]
    rows = [(i, "".join(rng.choice(["كتاب ", "vol ", "p. ", rng.choice(odd)]) for _ in range(6)), None if i % 5 else "", i) for i in range(300)]
    df = spark.createDataFrame(rows, "id bigint, t string, u string, changed int")
    all_rows = {(r["id"], r["field"]): r for r in visual.canonical_values(df, "id", ["t", "u"]).collect()}
    assert len(all_rows) == 300 + 60
    found = {(r["id"], r["field"]) for r in visual.canonical_values(df, "id", ["t", "u"], changed_only=True).collect()}
    assert found == {k for k, r in all_rows.items() if r["changed"]}
    m = visual.learn(df, ["t", "u"])
    for i, t, _, _ in rows:
        assert all_rows[i, "t"]["text"] == visual.canonical(t, m, {})
        assert all_rows[i, "t"]["changed"] == (all_rows[i, "t"]["text"] != t)
    again = spark.createDataFrame([(k[0], r["text"]) for k, r in all_rows.items()], "id bigint, t string")
    assert visual.canonical_values(again, "id", ["t"], changed_only=True).count() == 0


def test_suspect_pattern_needs_no_more(spark):
    odd = [chr(c) for c in range(32, 0x3000) if unicodedata.category(chr(c)) not in ("Cn", "Cs", "Co")]
    m = model(*CORPUS)
    df = spark.createDataFrame([(c, f"ab{c}") for c in odd], "c string, t string")
    passed = {r["c"] for r in df.where(~df["t"].rlike(visual.suspect_pattern())).collect()}
    assert [c for c in passed if visual.canonical(f"ab{c}", m, {}) != f"ab{c}"] == []


def test_long_and_empty(spark):
    long = "كتاب vol " * 20_000 + "vоl"
    df = spark.createDataFrame([(1, long)], "id bigint, t string")
    assert visual.canonical_values(df, "id", ["t"]).first()["text"] == long[:-3] + "vol"
    assert visual.canonical_values(df.limit(0), "id", ["t"]).count() == 0
    assert np.isfinite(visual.learn(df.limit(0), ["t"]).log).all() and re.compile("x")
