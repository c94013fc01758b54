"""Per-key results by value-frequency compression, against plain Python."""

import math
import random
from collections import Counter, defaultdict

import pytest

from corpuschain.operators import skew


def brute(rows):
    by = defaultdict(list)
    for k, v in rows:
        by[k].append(v)
    return by


def hot_rows(n=3000):
    rng = random.Random(7)
    return [(None if rng.random() < 0.02 else (1 if rng.random() < 0.5 else rng.randrange(2, 40)), None if rng.random() < 0.1 else rng.randrange(50)) for _ in range(n)]


def test_distinct_mode_and_rows(spark):
    rows = hot_rows()
    df = spark.createDataFrame(rows, "k int, v int")
    got = {r["k"]: r for r in skew.distinct_and_mode(skew.compress(df, "k", ["v"]), "k", "v").collect()}
    want = brute(rows)
    assert got.keys() == want.keys()
    for k, vs in want.items():
        there = [v for v in vs if v is not None]
        mode, n = min(Counter(there).items(), key=lambda x: (-x[1], x[0]))
        r = got[k]
        assert (r["n_rows"], r["n_values"], r["n_distinct"], r["mode"], r["mode_rows"]) == (len(vs), len(there), len(set(there)), mode, n)


@pytest.mark.parametrize("parts", [None, 1, 5])
def test_percentiles_of_weighted_values(spark, parts):
    rows = hot_rows()
    df = spark.createDataFrame(rows, "k int, v int")
    got = {r["k"]: r for r in skew.percentiles(skew.compress(df, "k", ["v"]), "k", "v", [0.0, 0.5, 0.9, 1.0], parts).collect()}
    for k, vs in brute(rows).items():
        there = sorted(v for v in vs if v is not None)
        for p in (0.0, 0.5, 0.9, 1.0):
            assert got[k][f"p{round(p * 100)}"] == there[max(1, math.ceil(p * len(there))) - 1], (k, p)


def test_only_nulls_and_extra_columns(spark):
    df = spark.createDataFrame([(1, None, "x"), (1, None, "y")], "k int, v int, n string")
    r = skew.distinct_and_mode(skew.compress(df, "k", ["v"]), "k", "v").first()
    assert (r["n_rows"], r["n_distinct"], r["mode"]) == (2, 0, None)
    assert skew.percentiles(skew.compress(df, "k", ["v"]), "k", "v", [0.5]).count() == 0
    with pytest.raises(ValueError):
        skew.compress(df.withColumnRenamed("v", "n_rows"), "k", ["n_rows"])


def test_empty(spark):
    df = spark.createDataFrame([], "k int, v int")
    assert skew.heavy_keys(df, "k").count() == 0
    assert skew.distinct_and_mode(skew.compress(df, "k", ["v"]), "k", "v").count() == 0
    assert skew.percentiles(skew.compress(df, "k", ["v"]), "k", "v", [0.5]).count() == 0


def test_heavy_keys_at_the_border(spark):
    rows = [(1,)] * 2 + [(None,)] * 50 + [(100 + i,) for i in range(148)]
    df = spark.createDataFrame(rows, "k int")
    assert [r["k"] for r in skew.heavy_keys(df, "k", 1).collect()] == [1]
    assert skew.heavy_keys(df, "k", 2).count() == 0
