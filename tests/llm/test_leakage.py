"""Leakage: folding, the winnowing guarantee, alignment, stock, and the operator against a brute-force search."""

import random

import numpy as np
import pytest

from corpuschain.llm import leakage as lk

RNG = random.Random(11)
VOCAB = [a + b + c for a in "bdfgklm" for b in "aeiou" for c in "nrst"]


def text(n, rng=RNG):
    return [rng.choice(VOCAB) for _ in range(n)]


@pytest.mark.parametrize(
    "a,b",
    [
        ("The QUICK, fox!", "the quick fox"), ("قَالَ أَحْمَدُ", "قال احمد"), ("<p>a</p> b&nbsp;c", "a b c"), ("ｆｕｌｌ wi​dth", "full width"),
        ("été É", "ete e"), ("[link](http://x.y/z) end", "link end"), ("صـــلاة کتاب ی ۵", "صلاه كتاب ي 5"), ("don't", "dont"), ("a_b", "a b"), ("", ""),
    ],
)
def test_folding(a, b):
    assert lk.words(a) == lk.words(b)


def test_winnowing_guarantee():
    memo = lk._Hashes()
    for _ in range(200):
        shared = text(7)
        a, b = text(RNG.randrange(30)) + shared + text(RNG.randrange(30)), text(RNG.randrange(30)) + shared + text(RNG.randrange(30))
        ha, hb = (lk.shingle_hashes(lk.hashed(x, memo), 5) for x in (a, b))
        assert set(ha[lk.winnow(ha, 3)]) & set(hb[lk.winnow(hb, 3)])


def test_winnow_picks_the_rightmost_smallest():
    h = np.array([5, 3, 3, 9, 1, 7], dtype=np.uint64)
    assert lk.winnow(h, 3).tolist() == [2, 4]
    assert lk.winnow(h[:2], 3).tolist() == [1] and lk.winnow(h[:0], 3).tolist() == []


def full_alignment(d, a):
    """Plain Smith-Waterman with the same scores: the best score."""
    m = np.zeros((len(a) + 1, len(d) + 1), dtype=int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(d) + 1):
            m[i, j] = max(0, m[i - 1, j - 1] + (1 if a[i - 1] == d[j - 1] else -2), m[i - 1, j] - 2, m[i, j - 1] - 2)
    return m.max()


def test_alignment_against_the_full_matrix():
    memo = lk._Hashes()
    for _ in range(40):
        a = text(40)
        part = a[5:35]
        for _ in range(RNG.randrange(4)):
            part[RNG.randrange(len(part))] = RNG.choice(VOCAB)
        if RNG.random() < 0.5:
            del part[RNG.randrange(5, 20)]
        d = text(20) + part + text(20)
        own, matched, a0, a1, d0, d1 = lk.align(lk.hashed(d, memo), lk.hashed(a, memo), np.zeros(len(a), dtype=bool), 15)
        assert own == matched
        best = full_alignment(d, a)
        misses = max(a1 - a0, d1 - d0) - matched
        assert matched - 2 * misses <= best <= matched, (best, matched, misses)


def brute(docs, items, least):
    """Items of which some run of words with at most every sixth changed stands in the document; for planted cases only."""
    return {(d, i) for d, t in docs.items() for i, w in items.items() if full_alignment([x.lower() for x in t], w) >= least - 4}


def test_operator(spark):
    stock = "read the passage below and answer the question after it".split()
    items = {i: (stock if i % 3 == 0 else []) + text(50) + (stock if i % 3 == 1 else []) for i in range(12)}
    docs, want = {}, set()
    for n in range(80):
        t, kind = text(60), n % 8
        i = n % 12
        body = items[i][10:50]
        if kind == 0:
            t, want = t + body + text(30), want | {(n, i)}
        elif kind == 1:
            part = body[:24]
            part[9] = "changed"
            t, want = text(5) + part + t, want | {(n, i)}
        elif kind == 2:
            t = t + stock + text(10)
        elif kind == 3:
            t = t + body[:9] + text(20)
        elif kind == 4:
            t, want = [w.upper() for w in body], want | {(n, i)}
        docs[n] = t
    rows = [(n, " ".join(t), "x") for n, t in docs.items()] + [(900, None, "x"), (901, "", "x"), (902, " ".join(text(40_000) + items[0] + text(40_000)), "x"), (903, " ".join(stock), "x")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, t string")
    e = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()] + [(50, None), (51, ""), (52, "short item"), (53, " ".join(stock))], "item_id bigint, text string")
    want |= {(902, 0)}
    for s in (lk.Settings(), lk.Settings(bits=8, salts=1)):
        hits = lk.leaks(d, "doc_id", "text", e, "item_id", "text", s)
        got = [(r["doc_id"], r["item_id"]) for r in hits.collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert want - {(902, 0)} == brute(docs, items, 20)
    counts = {r["item_id"]: r["n_documents"] for r in lk.leaked_items(hits, e, "item_id").collect()}
    assert counts[50] == counts[53] == 0 and sum(counts.values()) == len(want)


def found(spark, docs, items, **settings):
    d = spark.createDataFrame([(n, " ".join(t)) for n, t in docs.items()], "doc_id bigint, text string")
    e = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id bigint, text string")
    return {(r["doc_id"], r["item_id"]) for r in lk.leaks(d, "doc_id", "text", e, "item_id", "text", lk.Settings(**settings)).collect()}


@pytest.mark.parametrize("copies", [3, 50])
def test_copies_and_variants_of_an_item_are_no_stock(spark, copies):
    item = text(50)
    items = {}
    for n in range(copies):
        own = list(item)
        if n % 2:
            own[RNG.randrange(50)] = f"variant{n}"
        items[n] = own
    assert found(spark, {1: text(30) + item + text(30), 2: text(100)}, items) == {(1, n) for n in range(copies)}


def test_stock_of_different_items_and_a_passage_that_they_share(spark):
    stock, passage = text(12), text(45)
    items = {n: stock + text(40) for n in range(6)} | {10 + n: passage + text(12) for n in range(6)}
    got = found(spark, {1: text(20) + stock + text(20), 2: text(20) + passage + text(20), 3: items[2]}, items)
    assert got == {(2, 10 + n) for n in range(6)} | {(3, 2)}


def test_short_items_count_as_a_whole(spark):
    short, tiny = text(10), text(3)
    docs = {1: text(30) + short + text(30), 2: text(30) + short[:9] + text(30), 3: tiny, 4: tiny + text(1), 5: short}
    assert found(spark, docs, {1: short, 2: tiny}) == {(1, 1), (5, 1), (3, 2)}


def test_a_passage_of_twenty_words_with_two_single_changes(spark):
    item = text(60)
    docs, places = {}, [(x, y) for x in range(1, 18) for y in range(x + 2, 19)]
    for n, changed in enumerate(places):
        part = item[n % 40 : n % 40 + 20]
        for i in changed:
            part[i] = f"other{i}"
        docs[n] = text(10) + part + text(10)
    docs[900] = text(10) + item[5:20] + text(10)
    assert found(spark, docs, {1: item}) == {(n, 1) for n in range(len(places))}


def test_an_item_in_most_documents(spark):
    item = text(40)
    docs = {n: text(5) + item + text(5) if n % 3 else text(40) for n in range(300)}
    assert found(spark, docs, {7: item, 8: text(40)}) == {(n, 7) for n in docs if n % 3}


def test_empty(spark):
    d = spark.createDataFrame([], "doc_id bigint, text string")
    e = spark.createDataFrame([(1, "a b c d e f g h")], "item_id bigint, text string")
    assert lk.leaks(d, "doc_id", "text", e, "item_id", "text").count() == 0
    d = spark.createDataFrame([(1, "a b c d e f g h")], "doc_id bigint, text string")
    assert lk.leaks(d, "doc_id", "text", e.limit(0), "item_id", "text").count() == 0
