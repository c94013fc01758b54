"""Borůvka components against union-find."""

import random

import pytest

from corpuschain.llm.components import components


def union_find(pairs, ids=None):
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        if a is None or b is None or a == b or ids is not None and not {a, b} <= ids:
            continue
        ra, rb = root(a), root(b)
        up[max(ra, rb)] = min(ra, rb)
    return {(x, root(x)) for x in up}


def run(spark, pairs, ids=None):
    df = spark.createDataFrame(pairs, "id_a bigint, id_b bigint")
    known = None if ids is None else spark.createDataFrame([(i,) for i in ids], "id bigint")
    rows = [tuple(r) for r in components(df, "id_a", "id_b", known).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("seed,n,m", [(1, 60, 30), (2, 300, 250), (3, 500, 1500)])
def test_random_graphs(spark, seed, n, m):
    rng = random.Random(seed)
    pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
    assert run(spark, pairs) == union_find(pairs)


def test_long_chain_star_and_zigzag(spark):
    chain = [(i, i + 1) for i in range(1000, 1200)]
    star = [(5000, 5000 + i) for i in range(1, 300)]
    zigzag = [(2000 + i * 37 % 101, 2000 + (i + 1) * 37 % 101) for i in range(100)]
    pairs = chain + star + zigzag
    assert run(spark, pairs) == union_find(pairs)


def test_nulls_self_pairs_repeats_and_unknown_ids(spark):
    pairs = [(1, 2), (2, 1), (1, 2), (3, 3), (None, 1), (4, None), (None, None), (2, 99), (99, 5), (7, 8), (-4, 7)]
    ids = {1, 2, 3, 4, 5, 7, 8, -4}
    assert run(spark, pairs, ids) == union_find(pairs, ids) == {(1, 1), (2, 1), (-4, -4), (7, -4), (8, -4)}


def test_empty_and_clashing_columns(spark):
    assert run(spark, []) == set()
    df = spark.createDataFrame([(1, 2, "x", "y", 3)], "a bigint, b bigint, u string, p string, v int")
    known = spark.createDataFrame([(1, "q"), (2, "r")], "id bigint, u string")
    assert {tuple(r) for r in components(df, "a", "b", known).collect()} == {(1, 1), (2, 1)}
