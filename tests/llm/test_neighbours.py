"""The multi-index against brute force; traversal order; equal, zero and odd vectors."""

import random

import numpy as np
import pandas as pd
import pytest

from corpuschain.llm import neighbours as nb


def topics(n, d=16, seed=3):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(12, d))
    own = np.minimum(rng.geometric(0.35, n) - 1, 11)
    return (centre[own] + 0.4 * rng.normal(size=(n, d))).astype(np.float32)


def frame(spark, x, extra=()):
    rows = [(int(i), [float(a) for a in v], "x") for i, v in enumerate(x)] + list(extra)
    return spark.createDataFrame(rows, "id bigint, v array<float>, neighbour string")


def truth(ids, x, k):
    x = x.astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    cos = np.round(x @ x.T, 9)
    ids = np.asarray(ids)
    return {(int(ids[i]), int(ids[j])) for i in range(len(ids)) for j in [j for j in np.lexsort((ids, -cos[i])) if j != i][:k]}


def test_traversal_is_in_order_and_complete():
    rng = random.Random(2)
    for _ in range(50):
        n1, n2 = rng.randrange(1, 7), rng.randrange(1, 7)
        d1, d2 = np.array([rng.random() for _ in range(n1)]), np.array([rng.random() for _ in range(n2)])
        counts = np.array([[rng.choice([0, 0, 1, 5]) for _ in range(n2)] for _ in range(n1)])
        cells = nb.traverse(d1, d2, counts, 10**9)
        want = sorted(((d1[a] + d2[b], a, b) for a in range(n1) for b in range(n2) if counts[a, b]))
        assert cells == [(a, b) for _, a, b in want]
        some = nb.traverse(d1, d2, counts, 6, 0.0)
        assert some == cells[: len(some)] and (sum(counts[a, b] for a, b in some) >= 6 or len(some) == len(cells))
        if want:
            near = nb.traverse(d1, d2, counts, 0, 0.3)
            assert near == [(a, b) for far, a, b in want if far <= want[0][0] + 0.3]


def test_margin_over_all_vectors_is_exact(spark):
    x = topics(300)
    got = [(r["id"], r["neighbour"]) for r in nb.neighbours(frame(spark, x), "id", "v", 5).collect()]
    assert len(got) == len(set(got)) and set(got) == truth(range(300), x, 5)


@pytest.mark.parametrize("settings", [nb.Settings(asked=200, block=100, visitors=150), nb.Settings(asked=100, max_centroids=8, share=0.99)])
def test_recall_with_a_measured_margin(spark, settings):
    x = topics(1500)
    df = frame(spark, x)
    near = nb.neighbours(df, "id", "v", 5, settings).cache()
    want = truth(range(1500), x, 5)
    got = {(r["id"], r["neighbour"]) for r in near.collect()}
    assert len(got) == len(want) and len(got & want) / len(want) >= 0.95
    measured = nb.recall(df, near, "id", "v").first()
    asked = {p for p in want if p[0] % 20 == 0}
    assert tuple(measured) == (75, len(asked), len(asked & got))


def test_a_third_in_one_dense_topic_and_no_structure_at_all(spark):
    """Random directions are the hardest case, a dense topic the most uneven: both keep their recall."""
    rng = np.random.default_rng(4)
    dense = rng.normal(size=12) + 0.25 * rng.normal(size=(2000, 12))
    x = np.vstack([topics(2000, d=12), dense, rng.normal(size=(2000, 12))]).astype(np.float32)
    df = frame(spark, x)
    near = nb.neighbours(df, "id", "v", 5, nb.Settings(block=500, visitors=400))
    measured = nb.recall(df, near, "id", "v").first()
    assert measured["n_asked"] == 300 and measured["n_found"] >= 0.95 * measured["n_true"]


def test_blocks_are_bounded_on_the_entries_side():
    index = nb.Index(np.random.default_rng(1).normal(size=(6, 2)), np.random.default_rng(2).normal(size=(5, 2)))
    index.counts[:] = np.random.default_rng(3).integers(0, 40, (6, 5))
    index.counts[2, 3] = 1000
    index.group(100)
    held = {}
    for a in range(6):
        for b in range(5):
            n, parts = int(index.counts[a, b]), index.spread.get(a * 5 + b, 1)
            for p in range(parts):
                held[index.block_of[a, b] + p] = held.get(index.block_of[a, b] + p, 0) + n / parts
    assert index.spread[2 * 5 + 3] >= 10 and max(held.values()) <= 300


def test_ranks_and_ties(spark):
    x = np.array([[1, 0], [1, 0], [1, 0], [2, 0], [0, 1], [0.6, 0.8]], dtype=np.float32)
    rows = {(r["id"], r["rank"]): (r["neighbour"], r["cos"]) for r in nb.neighbours(frame(spark, x), "id", "v", 3).collect()}
    assert [rows[0, i][0] for i in (1, 2, 3)] == [1, 2, 3] and [rows[3, i][0] for i in (1, 2, 3)] == [0, 1, 2]
    assert [rows[4, i][0] for i in (1, 2)] == [5, 0] and rows[4, 1][1] == pytest.approx(0.8, abs=1e-7)


def test_many_equal_vectors(spark):
    x = np.vstack([np.tile(topics(1), (200, 1)), topics(40, seed=5)])
    got = {(r["id"], r["neighbour"]) for r in nb.neighbours(frame(spark, x), "id", "v", 5).collect()}
    assert got == truth(range(240), x, 5)


def test_odd_vectors_have_no_row(spark):
    x = topics(20, d=3)
    odd = [(100, None, "x"), (101, [0.0, 0.0, 0.0], "x"), (102, [], "x"), (103, [1.0, None, 0.0], "x"), (104, [float("nan"), 1.0, 1.0], "x"), (105, [1.0, 2.0], "x"), (106, [float("inf"), 0.0, 0.0], "x")]
    got = {(r["id"], r["neighbour"]) for r in nb.neighbours(frame(spark, x, odd), "id", "v", 4).collect()}
    assert got == truth(range(20), x, 4)


def test_small_tables(spark):
    assert nb.neighbours(frame(spark, []), "id", "v").count() == 0
    assert nb.neighbours(frame(spark, topics(1)), "id", "v").count() == 0
    pair = nb.unordered_pairs(nb.neighbours(frame(spark, topics(2)), "id", "v")).collect()
    assert [tuple(r) for r in pair] == [(0, 1)]
    one = spark.createDataFrame([(i, [float(i + 1)]) for i in range(4)], "id bigint, v array<float>")
    assert nb.neighbours(one, "id", "v", 2).count() == 8


def test_compare_without_rows():
    none = pd.DataFrame({"cell": [], "id": [], "v": [], "ids": []})
    assert len(nb.compare(none, pd.DataFrame({"id": [], "v": [], "cells": []}), 5)) == 0
