"""Truncation: the automaton, the ends, limits, and words that can't stand last."""

import random

import pytest

from corpuschain.llm import truncation as tr


@pytest.mark.parametrize(
    "text,is_open",
    [
        ("a (b) «c [d] e»", False), ("a (b", True), ("«a", True), ("a) b]", False), ("(a [b) c", False), ("«(a»", False), ("", False),
        ("<b>x</b> (y)", False), ("<a href='(' >x", True), ("<a href='(' >x</a>", False), ("“q", True),
        ('he said "abc', True), ('he said "abc" and "d"', False), ('5" wide', False), ('"a" b"', False), ('he said "a" and "b', True),
        ("<b>bold text", True), ("<p>some <i>text", True), ("<p>some text<br>", False), ("<ul><li>a<li>b</ul>", False), ("<img src=x/> y", False),
        ("a <!-- (b", True), ("a <!-- (b --> c", False), ("</b> x", False),
    ],
)
def test_automaton(text, is_open):
    assert tr.automaton(text) == is_open


@pytest.mark.parametrize(
    "text,core,broken,ended",
    [
        ("ab.", "ab.", False, True), ("ab&nb", "ab", True, False), ("ab&#16", "ab", True, False), ("ab</sp", "ab", True, False),
        ("ab<b", "ab", True, False), ("ab�", "ab", True, False), ("ab [...]", "ab", True, False), ("ab…", "ab", True, False),
        ("ab\\u06", "ab", True, False), ("ab%D", "ab", True, False), ("a & b", "a & b", False, False), ("a &amp; b.", "a &amp; b.", False, True),
        ("a < b.", "a < b.", False, True), ("قال:", "قال:", False, False), ("ab  ", "ab", False, False),
    ],
)
def test_ending(text, core, broken, ended):
    assert tr.ending(text) == (core, broken, ended)


def rows():
    """Book 1 ends in full stops, book 2 cuts at 60 characters, book 3 at 90 bytes, book 4 has no full stops."""
    rng = random.Random(1)
    nouns = ["window", "teacher", "garden", "river", "letter", "market", "student", "journey"]
    out = []
    for i in range(2400):
        book = 1 + i % 4
        text = " ".join(f"the {rng.choice(nouns)} of {rng.choice(nouns)} reads {rng.choice(nouns)}" for _ in range(rng.randrange(1, 5)))
        text += "" if book == 4 else "."
        cut = None
        if book == 2 and len(text) > 60:
            text, cut = text[:60].rstrip(), "limit"
        if book == 3:
            text = text.replace("e", "é")
            if len(text.encode()) > 90:
                text, cut = text.encode()[:90].decode(errors="ignore").rstrip(), "limit"
        out.append([i, book, text, cut])
    for i, end, cut in ((0, "the win", "word"), (4, "the river of", "sentence"), (8, "the river (of water", "open"), (12, "the river of wa�", "open"), (16, "the river … of river.", None), (20, "the letter of river reads river", None)):
        out[i][2:] = [out[i][2] + " " + end, cut]
    out[24][2:] = [None, None]
    out[28][2:] = ["  ", None]
    return out


def test_reasons_and_rates(spark):
    data = rows()
    df = spark.createDataFrame([(*r[:3], "x") for r in data], "id bigint, book int, t string, word string")
    judged = tr.judge(df, "id", "book", ["t"])
    got = {r["id"]: r["reason"] for r in judged.collect()}
    want = {r[0]: r[3] for r in data if r[2] and r[2].strip()}
    assert got.keys() == want.keys()
    wrong = {k: (got[k], want[k], data[k][2][-30:]) for k in want if got[k] != want[k]}
    assert len(wrong) <= 4, wrong  # a cut that falls at a full sentence of just the limit
    for i in (0, 4, 8, 12, 16, 20):
        assert got[i] == want[i]
    rates = {r["book"]: r for r in tr.rates(judged, "book").collect()}
    assert rates[2]["n_limit"] > 100 and rates[3]["n_limit"] > 100 and rates[1]["n_cut"] == 4 and rates[4]["n_cut"] == 0
    assert rates[1]["n_values"] == 598


def test_a_missing_terminator_in_a_strict_source(spark):
    """Of 1,000 values of book 1 two lack the full stop, of book 2 every tenth."""
    text = lambda n: "the river " + "on " * (n % 83) + "of water"
    rows = [(n, 1, text(n) + ("" if n in (3, 500) else ".")) for n in range(1000)] + [(n, 2, text(n) + ("" if n % 10 == 0 else ".")) for n in range(1000, 2000)]
    got = tr.judge(spark.createDataFrame(rows, "id bigint, book int, t string"), "id", "book", ["t"]).where("reason IS NOT NULL").collect()
    assert {(r["id"], r["reason"]) for r in got} == {(3, "end"), (500, "end")}


def test_null_source_ties_long_and_empty(spark):
    long = "the river of water. " * 20_000
    df = spark.createDataFrame([(1, None, long), (1, None, long), (2, None, "«x")], "id bigint, book int, t string")
    got = sorted((r["id"], r["book"], r["reason"]) for r in tr.judge(df, "id", "book", ["t"]).collect())
    assert got == [(1, None, None), (1, None, None), (2, None, "open")]
    assert tr.judge(df.limit(0), "id", "book", ["t"]).count() == 0


@pytest.mark.parametrize("times", [1, 10])
def test_fragments_at_any_size(spark, times):
    """A fragment that stands elsewhere too is one as long as it begins far more words; ``river`` is a word of its own."""
    texts = ["the window of water."] * 60 + ["a win of water.", "riverside river riverside.", "the water of the win", "the water of the river"]
    rows = [(i, 1, t) for i, t in enumerate(texts * times)]
    judged = tr.judge(spark.createDataFrame(rows, "id bigint, book int, t string"), "id", "book", ["t"])
    assert {r["id"] for r in judged.where("reason = 'word'").collect()} == {i for i, _, t in rows if t.endswith("the win")}
