"""The mixture: exact round trip of the token streams, permutations, quotas, caps and shares."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from corpuschain.llm import mixture as mx

S = mx.Settings(block=16, shard=8, group=4)
SEPARATOR = mx.tokenizer(S.folder, S.vocabulary, S.pattern)[1]


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000])
def test_permutation(n):
    a, b = mx.permuted(np.arange(n), n, 1), mx.permuted(np.arange(n), n, 2)
    assert sorted(a) == sorted(b) == list(range(n))
    assert n < 20 or (a != b).any()


def test_quotas():
    plan = {s: q for s, _, q, _ in mx.quotas([("a", 0.5, 1), ("b", 0.5, 4), ("none", 0.3, 2), ("zero", 0.0, 2), ("never", 0.2, 0)], {"a": 1600, "b": 800, "zero": 10, "never": 10}, 16)}
    assert plan == {"a": 100, "b": 100}
    assert mx.quotas([("a", 1.0, 1)], {}, 16) == [] and mx.quotas([], {"a": 5}, 16) == []
    assert mx.quotas([("a", None, 1), ("b", float("nan"), 1)], {"a": 5, "b": 5}, 16) == []


def corpus(n=150):
    rng = random.Random(2)
    words = ["river", "كتاب", "chaîne", "market ", "\n", "x" * 30, "😀"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 60))), rng.choice(["big"] * 6 + ["Small-One ", "small one", "SMALL_ONE", "mid", "unlisted", None])) for i in range(n)]
    return rows + [(900, None, "big", ), (901, "", "big"), (902, "  ", "mid")]


TARGETS = [("big", 0.5, 1), ("small_one", 0.3, 3), ("mid", 0.1, 2), ("absent", 0.1, 2)]


def frames(spark, rows, parts=3):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(parts)
    return docs, spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")


def expected(rows, s):
    """Each source's tokens, document by document."""
    out = defaultdict(Counter)
    for _, t, source in rows:
        if t and t.strip() and source:
            key = "small_one" if source.strip().lower().replace("-", "_").replace(" ", "_") == "small_one" else source
            out[key][tuple(mx.encode(t, s).tolist())] += 1
    return out


def test_mixture(spark):
    rows = corpus()
    docs, targets = frames(spark, rows)
    mixed, report = mx.mixture(docs, "doc_id", "text", "source", targets, S)
    slots = mixed.collect()
    rep = {r["source"]: r for r in report.collect()}
    want = expected(rows, S)
    by = defaultdict(dict)
    uses = Counter()
    for r in slots:
        tokens = mx.unpack(bytes(r["tokens"]))
        assert len(tokens) == r["n_tokens"] <= S.block
        assert by[r["source"]].setdefault(r["block"], tokens) == tokens
        uses[r["source"], r["block"]] += 1
        assert (r["source"], r["block"], r["epoch"]) not in uses
        uses[r["source"], r["block"], r["epoch"]] = 0
    assert set(by) == {"big", "small_one", "mid"} and set(rep) == {"big", "small_one", "mid", "absent"}
    for source, _, repeats in TARGETS[:3]:
        assert max(n for k, n in uses.items() if k[0] == source) <= repeats
        assert rep[source]["most_uses"] <= repeats
        n = sum(len(d) * c for d, c in want[source].items())
        assert rep[source]["n_tokens"] == n
        if len(by[source]) == -(-n // S.block):  # all blocks came out: the stream is the documents, whole, in some order
            stream = [t for b in sorted(by[source]) for t in by[source][b]]
            docs_found, one = Counter(), []
            for t in stream:
                one.append(t)
                if t == SEPARATOR:
                    docs_found[tuple(one)] += 1
                    one = []
            assert not one and docs_found == want[source]
    assert any(len(by[s]) == -(-rep[s]["n_tokens"] // S.block) for s in by)
    total = sum(r["n_tokens"] for r in slots)
    for source, share, _ in TARGETS[:3]:
        got = sum(r["n_tokens"] for r in slots if r["source"] == source)
        assert rep[source]["mixed_tokens"] == got and abs(rep[source]["share"] - got / total) < 1e-6
        assert abs(got / total - share / 0.9) < 0.02
    shards = Counter(r["shard"] for r in slots)
    assert len({(r["shard"], r["slot"]) for r in slots}) == len(slots) and all(n == S.shard for k, n in shards.items() if k < max(shards) - S.group)


def test_same_for_any_partitioning(spark):
    rows = corpus(80)
    results = []
    for parts in (1, 5):
        docs, targets = frames(spark, rows, parts)
        mixed, _ = mx.mixture(docs, "doc_id", "text", "source", targets, S)
        results.append(sorted((r["shard"], r["slot"], bytes(r["tokens"])) for r in mixed.collect()))
    assert results[0] == results[1]


def test_long_text_round_trip():
    text = "كتاب the river  " * 20_000
    s = mx.Settings()
    ids = mx.encode(text, s).tolist()
    assert ids[-1] == SEPARATOR and mx.tokenizer(s.folder, s.vocabulary, s.pattern)[0].decode(ids[:-1]) == text


def test_empty(spark):
    docs, targets = frames(spark, corpus(0))
    mixed, report = mx.mixture(docs, "doc_id", "text", "source", targets, S)
    assert mixed.count() == 0 and [r["share"] for r in report.collect()] == [0.0] * 4
    assert mx.mixture(docs.limit(0), "doc_id", "text", "source", targets.limit(0), S)[0].count() == 0


def test_another_vocabulary_has_its_own_separator(tmp_path):
    import base64

    ranks = [bytes([i]) for i in range(256)] + [b"ab", b"abc"]
    (tmp_path / "small.tiktoken").write_bytes(b"\n".join(base64.b64encode(t) + b" " + str(i).encode() for i, t in enumerate(ranks)))
    s = mx.Settings(folder=str(tmp_path), vocabulary="small.tiktoken")
    assert mx.encode("abc d", s).tolist() == [257, 32, 100, 258]
