"""Retrieval, parallels, graphs, books and entities against plain Python."""

import math
import random
from collections import Counter, defaultdict
from itertools import combinations

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpuschain import queries
from corpuschain.functions import text as T
from corpuschain.plans import verdicts
from corpuschain.operators import books, entity, graph, index, overlap, search

VOCAB = [f"w{i}" for i in range(40)]


def docs(n=60, seed=1):
    rng = random.Random(seed)
    return {i: [rng.choice(VOCAB[: rng.choice([8, 40])]) for _ in range(rng.randrange(0, 15))] for i in range(n)}


def frame(spark, d):
    return spark.createDataFrame(list(d.items()), "id bigint, words array<string>")


@pytest.mark.parametrize("match", ["or", "and", "auto"])
def test_bm25(spark, match):
    d, terms = docs(), ["w1", "w3", "w30"]
    n, mean = len(d), sum(map(len, d.values())) / len(d)
    df = {t: sum(t in w for w in d.values()) for t in terms}
    want = {}
    for i, w in d.items():
        c = Counter(w)
        hit = [t for t in terms if c[t]]
        if hit and (match == "or" or len(hit) == len(terms)):
            idf = lambda t: max(math.log((n - df[t] + 0.5) / (df[t] + 0.5)), 0) or search.FLOOR
            want[i] = sum(idf(t) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * len(w) / mean)) for t in hit)
    if match == "auto" and not want:
        pytest.skip("no record has all")
    got = {r["id"]: r["score"] for r in search.bm25(frame(spark, d), "id", {"words": F.col("words")}, terms, match=match).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)


def test_bm25_edges(spark):
    df = frame(spark, docs())
    assert search.bm25(df, "id", {"words": F.col("words")}, [], match="or").count() == 0
    assert search.bm25(df.limit(0), "id", {"words": F.col("words")}, ["w1"], match="or").count() == 0
    with pytest.raises(ValueError):
        search.bm25(df, "id", {"words": F.col("words")}, ["w1"], match="xor")


def test_facets_fusion_and_vectors(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), (None, "x")], "p string, q string")
    got = {(r["facet"], r["value"]): r["n"] for r in search.multi_select_facets(df, {"p": F.col("p") == "a", "q": F.col("q") == "x"}, "p", "q").collect()}
    assert got == {("p", "a"): 1, ("p", "b"): 1, ("q", "x"): 1, ("q", "y"): 1}
    one = spark.createDataFrame([(1, 1), (2, 2)], "id bigint, rank bigint")
    fused = {r["id"]: r["score"] for r in search.reciprocal_rank_fusion(one, one.where("id = 2")).collect()}
    assert abs(fused[2] - 2 / 62) < 1e-12 and abs(fused[1] - 1 / 61) < 1e-12
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, [1.0]), (4, None)], "id bigint, v array<float>")
    assert [r["id"] for r in search.vector_top(v, "id", "v", [0.0, 1.0], 5).collect()] == [2, 1]


def test_hash_embedding(spark):
    import hashlib

    words = ["a", "b", "a", "كتاب"]
    counts = [0.0] * 16
    for w in words:
        counts[int(hashlib.md5(w.encode()).hexdigest(), 16) % 16] += 1
    norm = math.sqrt(sum(c * c for c in counts))
    df = spark.createDataFrame([(words,), ([],)], "w array<string>")
    got = [r["e"] for r in df.select(search.hash_embedding(F.col("w"), 16).alias("e")).collect()]
    assert got[0] == pytest.approx([c / norm for c in counts]) and got[1] == [0.0] * 16


@pytest.mark.parametrize("t", [0.5, 0.8, 1.0])
def test_similar_pairs(spark, t):
    d = docs(80, 3)
    sets = overlap.word_sets(frame(spark, d), "id", F.col("words"), 2)
    distinct, members = overlap.representatives(sets)
    got = {(r["a"], r["b"]): r["overlap"] for r in overlap.similar_pairs(distinct, t).collect()}
    keep = {}
    for i, w in sorted(d.items()):
        if len(set(w)) >= 2:
            keep.setdefault(frozenset(w), i)
    want = {}
    for (a, i), (b, j) in combinations(keep.items(), 2):
        o = len(a & b) / min(len(a), len(b))
        if round(o, 9) >= t:
            want[min(i, j), max(i, j)] = o
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert {r["id"]: r["rep"] for r in members.collect()} == {i: keep[frozenset(w)] for i, w in d.items() if len(set(w)) >= 2}


@pytest.mark.parametrize("t", [0.3, 0.8, 1.0])
def test_blocks_against_all_pairs(monkeypatch, t):
    """Sets packed into small blocks, counted in small tables: each pair once, in either order of blocks."""
    for name, value in (("BLOCK", 150), ("CELLS", 90), ("PIECE", 3), ("PAIRS", 5)):
        monkeypatch.setattr(overlap, name, value)
    rng = random.Random(4)
    kept = {i: sorted({hash(("w", x)) for x in rng.sample(range(30), rng.randrange(1, 20))}) for i in rng.sample(range(1000), 90)}
    rows = list(kept.items())
    batches = [pa.RecordBatch.from_pydict({"id": [i for i, _ in part], "h": pa.array([h for _, h in part], pa.list_(pa.int64()))}) for part in (rows[:70], rows[70:])]
    made = [overlap.unpacked(b, 0) for b in overlap._blocks(iter(batches))]
    got = [(s, l, round(o, 9)) for x in made for y in made for found in overlap.between(x, y, t) for s, l, o in zip(*(c.tolist() for c in found), strict=True)]
    want = set()
    for i, j in combinations(kept, 2):
        small, large = sorted((i, j), key=lambda k: (len(kept[k]), k))
        o = round(len({*kept[i]} & {*kept[j]}) / len(kept[small]), 9)
        if o >= t:
            want.add((small, large, o))
    assert len(made) > 4 and len(got) == len(want) and set(got) == want


def test_candidates_are_not_shuffled(spark):
    """Sets that share common words only are compared in the task that reads them: no exchange and no broadcast."""
    distinct, _ = overlap.representatives(overlap.word_sets(frame(spark, docs(80, 3)), "id", F.col("words"), 2))
    plan = overlap.similar_pairs(distinct, 0.8)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan


def test_similar_links_are_a_forest(spark):
    """Fifty near copies have over a thousand pairs and are linked by 49; the groups are those of all pairs."""
    d = {i: [*VOCAB[:30], f"x{i}"] for i in range(50)} | {i: [*VOCAB[i % 7 : 14 + i % 3], f"y{i}"] for i in range(100, 130)}
    distinct, _ = overlap.representatives(overlap.word_sets(frame(spark, d), "id", F.col("words"), 2).coalesce(1))
    pairs, links = (f(distinct.coalesce(1), 0.8) for f in (overlap.similar_pairs, overlap.similar_links))
    groups = [{tuple(r) for r in graph.connected(x).collect()} for x in (pairs, links)]
    found, every = {tuple(r) for r in links.collect()}, {(r["a"], r["b"]) for r in pairs.collect()}
    assert len(every) > 1225 and found <= every and groups[0] == groups[1]
    assert len(found) == len(groups[0]) - len({top for _, top in groups[0]})


def test_against_and_leaders(spark):
    d = docs(40, 5)
    sets = overlap.word_sets(frame(spark, d), "id", F.col("words"))
    got = {(r["q"], r["id"]) for r in overlap.against(sets.where("id % 20 = 0"), sets, 0.4).collect()}
    want = {(q, i) for q in d if q % 20 == 0 for i in d if i != q and d[q] and d[i] and len({*d[q]} & {*d[i]}) / min(len({*d[q]}), len({*d[i]})) >= 0.4}
    assert got == want
    ranked = frame(spark, {1: ["a", "b"], 2: ["a", "b", "c"], 3: ["x"], 4: []}).withColumn("rank", F.col("id"))
    assert {tuple(r) for r in overlap.leaders(ranked, "rank", "id", "words").collect()} == {(1, 1), (2, 1), (3, 3), (4, 4)}
    assert {tuple(r) for r in overlap.leaders(ranked, "rank", "id", "words", cap=1).collect()} == {(1, 1), (2, 2), (3, 3), (4, 4)}


def test_networks(spark):
    rows = [(c, p, n, r) for c, names in {1: ["a", "b", "c"], 2: ["a", "b", None, "d"], 3: ["b", "b", "a"], 4: ["x"]}.items() for p, (n, r) in enumerate(zip(names, [False] * 9, strict=False))]
    rows.append((1, 3, "z", True))
    chains = spark.createDataFrame(rows, "chain int, pos int, name string, start boolean")
    links = graph.links(chains, "chain", "pos", "name", "start")
    weights = {(r["teacher"], r["student"]): r["weight"] for r in graph.edge_weights(links).collect()}
    assert weights == {("b", "a"): 2, ("c", "b"): 1, ("a", "b"): 1}
    assert {r["node"]: r["neighbours"] for r in graph.adjacency(graph.edge_weights(links)).collect()} == {"a": ["b"], "b": ["a", "c"], "c": ["b"]}
    seen = {r["chain"]: (r["n_links"], r["n_seen"]) for r in graph.continuity(links, graph.edge_weights(links).where("weight >= 2"), "chain").collect()}
    assert seen == {1: (2, 1), 2: (1, 1), 3: (1, 0)}


def test_context_map(spark):
    chains = [("s", "ali", "t")] * 1 + [("s", "ali b zayd", "t")] * 2 + [("s", "umar b a", "u")] * 2 + [("s", "umar b c", "u")] * 2
    rows = [(i, p, n) for i, c in enumerate(chains) for p, n in enumerate(c)]
    df = spark.createDataFrame(rows, "chain int, pos int, name string")
    known = graph.context_map(df, "chain", "pos", "name")
    assert [tuple(r) for r in known.collect()] == [("s", "t", "ali b zayd", 2)]
    got = {r["chain"]: r["resolved"] for r in graph.apply_context(df, "chain", "pos", "name", known).where("pos = 1").collect()}
    assert got[0] == "ali b zayd" and got[3] == "umar b a"


def test_propagate(spark):
    positions = [(1, 0, ["A"], False), (1, 1, ["B1", "B2"], False), (1, 2, ["C1", "C2"], False), (1, 3, ["D"], False), (2, 0, ["A"], False), (2, 1, ["B1", "B2"], True), (3, 0, ["B1", "B2"], False)]
    network = [("B1", "A"), ("C2", "B1"), (None, "A")]
    p = spark.createDataFrame(positions, "chain int, pos int, candidates array<string>, route_start boolean")
    got = {(r["chain"], r["pos"]): r["resolved"] for r in graph.propagate(p, spark.createDataFrame(network, "teacher string, student string")).collect()}
    assert got == {(1, 0): "A", (1, 1): "B1", (1, 2): "C2", (1, 3): "D", (2, 0): "A", (2, 1): None, (3, 0): None}


def test_connected(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(90), rng.randrange(90)) for _ in range(60)] + [(200 + i, 201 + i) for i in range(40)] + [(5, 5)]
    up = {}
    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x
    for a, b in pairs:
        if a != b:
            ra, rb = root(a), root(b)
            up[max(ra, rb)] = min(ra, rb)
    got = {tuple(r) for r in graph.connected(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert got == {(x, root(x)) for x in up}
    assert graph.connected(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_verdicts(spark):
    rows = [(1, 9, False, [8]), (1, 7, False, None), (2, None, False, None), (2, 9, False, []), (3, 2, True, None), (3, 9, False, None), (4, 1, False, None)]
    got = {r["c"]: tuple(r)[1:] for r in graph.weakest(spark.createDataFrame(rows, "c int, rank int, hidden boolean, o array<int>"), "c", "rank", "hidden", "o").collect()}
    assert got == {1: (7, 2, 0, 0), 2: (9, 1, 1, 0), 3: (9, 1, 0, 1), 4: (1, 1, 0, 0)}
    cases = [(9, 0, 0, True, "sound"), (9, 0, 0, False, "sound if hearing is confirmed"), (8, 0, 0, True, "good"), (9, 1, 0, True, "suspended"), (5, 1, 0, True, "supporting"), (9, 0, 1, True, "weak"), (1, 0, 1, True, "very weak"), (None, 0, 0, True, "not ruled"), (3, 0, 0, True, "weak")]
    df = spark.createDataFrame(cases, "w int, u int, h int, heard boolean, want string")
    assert all(r["got"] == r["want"] for r in df.select("want", graph.ruling(F.col("w"), F.col("u"), F.col("h"), F.col("heard")).alias("got")).collect())


def test_books(spark):
    marks = spark.createDataFrame([(1, 1, 1, "A"), (1, 2, 2, "B"), (1, 4, 1, "C"), (1, 4, 3, "D")], "b int, p int, l int, t string")
    pages = spark.createDataFrame([(1, p) for p in (1, 2, 3, 4, 5)] + [(2, 1)], "b int, p int")
    got = {(r["b"], r["p"]): r["path"] for r in books.open_headings(marks, pages, "b", "p", "l", "t").collect()}
    assert got == {(1, 1): "A", (1, 2): "A / B", (1, 3): "A / B", (1, 4): "C / D", (1, 5): "C / D", (2, 1): None}
    df = spark.createDataFrame([(1, 1, "x"), (1, 2, ""), (1, 3, None), (1, 4, "y"), (2, 5, "")], "b int, i int, v string")
    empty = F.coalesce(F.col("v"), F.lit("")) == ""
    assert {r["i"]: r["v"] for r in books.inherited(df, "b", ["i"], "v", empty).collect()} == {1: "x", 2: "x", 3: "x", 4: "y", 5: None}
    starts = spark.createDataFrame([(1, 3), (1, 7), (1, 8)], "b int, s int")
    assert {r["s"]: r["e"] for r in books.ranges(starts, "b", "s", "e", F.lit(20)).collect()} == {3: 6, 7: 7, 8: 20}
    chunks = spark.createDataFrame([(1, 1, "b"), (1, 0, "a"), (2, 0, "c")], "k int, pos int, text string")
    assert {tuple(r) for r in books.passages(chunks, ["k"], "pos", "text").collect()} == {(1, "a b"), (2, "c")}


def test_entities(spark):
    df = spark.createDataFrame([(1, "عبد الله بن زيد بن ثابت الأنصاري"), (2, "زيد بن عمرو المدني"), (3, "أبو بكر"), (4, None)], "i int, n string")
    r = {x["i"]: x for x in df.select("i", entity.lineage(F.col("n")).alias("l"), entity.ident_key(F.col("n")).alias("k"), entity.nisbas(F.col("n")).alias("s")).collect()}
    assert r[1]["l"] == ["عبد الله", "زيد", "ثابت"] and r[1]["k"] == "عبد الله زيد" and r[1]["s"] == ["الانصاري"]
    assert r[3]["k"] == "ابو بكر" and r[4]["l"] is None
    rows = [(1, 2, None, "s"), (1, 1, "x", None), (1, 3, "y", "t"), (2, 9, None, None)]
    merged = entity.merged_gaps(spark.createDataFrame(rows, "g int, o int, a string, b string"), "g", ["o"], ["a", "b"])
    assert {tuple(x) for x in merged.collect()} == {(1, 3, "x", "s"), (2, 1, None, None)}
    ops = spark.createDataFrame([(1, [("s", "good"), ("s", "bad"), ("t", "good"), (None, "x")]), (2, [("s", "a"), ("t", "b")]), (3, None)], "k int, o array<struct<source:string,grade:string>>")
    assert {x["k"]: (len(x["opinions"]), x["disputed"]) for x in entity.opinions_by_source(ops, "k", "o").collect()} == {1: (2, False), 2: (2, True)}


def brute_lookup(q, forms):
    found = []
    for e, f in forms:
        if f == q[: len(f)] and not (len(f) == 1 and len(set(q)) > 1):
            found.append(((2, len(f), 0), e))
        elif q == f[: len(q)]:
            found.append(((1, len(q), 1), e))
        elif [t for t in f if t in q] == q:
            found.append(((1, len(q), 0), e))
    best = max((lv for lv, _ in found), default=None)
    tops = {e for lv, e in found if lv == best}
    return {(e, {2: 1.0}.get(best[0], 0.8 if best[2] else 0.5), len(tops) > 1) for e in tops}


def test_lookup(spark):
    rng = random.Random(7)
    names = [[rng.choice("abcdef") for _ in range(rng.randrange(1, 5))] for _ in range(40)]
    forms = [(i, n) for i, n in enumerate(names) if len(set(n)) == len(n)]
    asked = [(i, [rng.choice("abcdef") for _ in range(rng.randrange(1, 4))]) for i in range(60)]
    got = defaultdict(set)
    for r in entity.lookup(spark.createDataFrame(asked, "q bigint, tokens array<string>"), spark.createDataFrame(forms, "entry bigint, tokens array<string>")).collect():
        got[r["q"]].add((r["entry"], r["score"], r["ambiguous"]))
    for q, tokens in asked:
        assert got[q] == brute_lookup(tokens, forms), tokens


def test_collapse(spark):
    rows = [
        (1, "زيد بن عمرو بن بكر المدني", 200, None, 9), (2, "زيد بن عمرو المدني", None, None, 9), (3, "زيد بن عمرو البصري", 200, None, 9),
        (4, "زيد بن عمرو", 210, None, 9), (5, "زيد بن عمرو", 260, None, None), (6, "زيد بن عمرو", 260, None, None), (7, None, 200, None, 9),
        (8, "خالد بن زيد", None, "أبو بكر", 9), (9, "خالد بن زيد", None, "أبو بكر", 2), (10, "خالد بن زيد", None, "أبو عمر", 2), (11, "", None, None, None),
    ]
    df = spark.createDataFrame(rows, "i bigint, n string, y int, k string, r int")
    got = {x["i"]: x["man"] for x in entity.collapse(df, "i", "n", "y", "k", "r").collect()}
    # 4 is within twenty years of both 1 and 3, which alone exclude each other
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 5, 7: 7, 8: 8, 9: 8, 10: 10, 11: 11}
    assert entity.collapse(df.limit(0), "i", "n", "y", "k", "r").count() == 0


def test_lineage(spark):
    for name, line in [
        ("محمد بن أبي بكر", ["محمد", "ابي بكر"]), ("محمد بن أبي طالب", ["محمد", "ابي طالب"]), ("هشام بن عمار بن نصير السلمي الدمشقي", ["هشام", "عمار", "نصير"]),
        ("عمار بن ياسر أبو اليقظان", ["عمار", "ياسر"]), ("عبد الأعلى بن عبد الغني الكوفي", ["عبد الاعلي", "عبد الغني"]), ("أحمد بن علي الصغير", ["احمد", "علي"]), ("أبو بكر", []),
    ]:
        got = spark.createDataFrame([(name,)], "n string").select(entity.lineage(F.col("n")).alias("l")).first()["l"]
        assert got == line, (name, got)


def test_different_men_stay_apart(spark):
    rows = [
        (1, "محمد بن أبي بكر", 100, None, 9), (2, "محمد بن أبي طالب", 110, None, 9),  # other fathers
        (3, "زيد بن عمرو المدني", 100, None, 9), (4, "زيد بن عمرو المدني", 110, None, 2),  # one trusted, one weak
        (5, "أحمد بن علي الكبير", 200, None, 9), (6, "أحمد بن علي الصغير", 205, None, 9),  # generations
        (7, "يحيى بن سعيد بن قيس الأنصاري", None, None, 9), (8, "يحيى بن سعيد بن قيس بن عمرو", None, None, 8),  # three generations agree
        (9, "بكر بن سعد بن قيس", None, None, 10), (10, "بكر بن سعد بن قيس بن زيد", None, None, 9),  # a Companion and another
    ]
    df = spark.createDataFrame(rows, "i bigint, n string, y int, k string, r int")
    assert {x["i"]: x["man"] for x in entity.collapse(df, "i", "n", "y", "k", "r").collect()} == {i: 7 if i == 8 else i for i in range(1, 11)}


def test_verdicts(spark):
    """The Prophet counts as no narrator; a name for two men has a rank where they agree; a gap suspends, an unnamed man weakens."""
    entries = [
        (1, "زيد بن عمرو المدني", "ثقة", []), (2, "بكر بن خالد", "صدوق", [("s", "ضعيف")]), (3, "نافع مولى ابن عمر", "ثقة", None),
        (4, "سالم بن زيد", "ثقة", []), (5, "سالم بن عمر", "ثقة", []), (6, "حماد بن زيد", "ثقة", []), (7, "حماد بن سلمة", "ضعيف", []), (8, "لا حكم فيه", None, []),
    ]
    e = spark.createDataFrame(entries, "i bigint, n string, g string, o array<struct<source:string,grade:string>>")
    forms = e.select(F.col("i").alias("entry"), T.words(T.normalize(F.col("n"))).alias("tokens"))
    graded = verdicts.graded_entries(e, "i", "g", "o")
    ranks = {r["entry"]: r["rank"] for r in graded.collect()}
    assert ranks[1] == 9 and ranks[2] == 2 and ranks[3] == 9 and ranks[8] is None
    chains = {
        1: [("زيد بن عمرو", "heard"), ("نافع", "heard"), ("رسول الله", "head")], 2: [("زيد بن عمرو", "heard"), ("نافع", "from")], 3: [("زيد بن عمرو", "heard"), ("بكر بن خالد", "heard")],
        4: [("زيد بن عمرو", "heard"), ("غريب", "heard")], 5: [("زيد بن عمرو", "heard"), ("رجل", "heard")], 6: [("سالم", "heard")], 7: [("حماد", "heard")], 8: [("النبي", "head")],
    }
    rows = [(c, p, n, v, False) for c, names in chains.items() for p, (n, v) in enumerate(names)]
    df = spark.createDataFrame(rows, "chain bigint, pos int, name string, via string, route_start boolean")
    got = {r["chain"]: tuple(r)[1:] for r in verdicts.verdicts(df, forms, graded).collect()}
    assert got == {
        1: (9, 2, 0, 0, 2, 1, "sound"), 2: (9, 2, 0, 0, 1, 1, "sound if hearing is confirmed"), 3: (2, 2, 0, 0, 1, 0, "weak"), 4: (9, 1, 1, 0, 1, 0, "suspended"),
        5: (9, 1, 0, 1, 1, 0, "weak"), 6: (9, 1, 0, 0, 0, 0, "sound"), 7: (None, 0, 1, 0, 0, 0, "not ruled"),
    }
    assert verdicts.verdicts(df.limit(0), forms, graded).count() == 0


def test_stored_index(spark, tmp_path):
    """Scores are those of the table itself; a search reads the folders of its terms only."""
    rng = random.Random(5)
    rows = [(i, [rng.choice("abcdefgh") for _ in range(rng.randrange(6))] or None, [rng.choice("abxy")], "k") for i in range(200)]
    df = spark.createDataFrame(rows, "i bigint, t array<string>, u array<string>, term string")
    columns, weights = {"t": F.col("t"), "u": F.col("u")}, {"t": 3.0, "u": 1.0}
    made = index.build(df, "i", columns, str(tmp_path / "x"), {"kind": F.col("term")}, buckets=8)
    for match, fields in (("or", None), ("and", None), ("auto", None), ("or", ["u"])):
        want = {tuple(r) for r in search.bm25(df, "i", columns, ["a", "x", "nowhere"] if match == "auto" else ["a", "x"], weights, match, fields).collect()}
        got = {tuple(r) for r in made.search(["a", "x", "nowhere"] if match == "auto" else ["a", "x"], weights, match, fields).collect()}
        assert got == want and got
    plan = made.of(["a"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "PushedFilters: [IsNotNull(term), EqualTo(term,a)]" in plan
    assert made.records.count() == 200 and made.statistics.first()["n"] == 200
    assert index.build(df.limit(0), "i", columns, str(tmp_path / "e")).search(["a"], weights).count() == 0


def test_overlap_parallels_by_meaning(spark, tmp_path):
    """The registered query keeps parallels from 0.40 on."""
    texts = {20: "ب ت ث ج ح", 1: "ب ت خ د ر", 2: "ب ت ث ج ز", 3: "ب س ش ص ط"}
    rows = [(i, i, i, "hadith", t) for i, t in texts.items()]
    spark.createDataFrame(rows, "id bigint, book_id int, number int, kind string, matn string").write.parquet(f"{tmp_path}/hadith.parquet")
    got = {tuple(r) for r in queries.overlap_parallels(spark, str(tmp_path)).collect()}
    assert got == {(20, 1, 0.4, "by meaning"), (20, 2, 0.8, "near")}


def test_near_dup_components_has_every_document(spark, tmp_path):
    long = " ".join(VOCAB[:20])
    texts = {1: "see note", 2: "Note, see", 3: "see", 4: "", 5: None, 6: long, 7: long + " x", 8: " . "}
    spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in queries.near_dup_components(spark, str(tmp_path)).collect()}
    assert got == {(1, 1), (2, 1), (3, 3), (4, 4), (5, 5), (6, 6), (7, 6), (8, 8)}


def test_hash_embed_takes_whole_bodies(spark, tmp_path):
    rows = [(1, "كتاب قلم كتاب", "x"), (2, "قلم", "x"), (3, None, "x"), (4, "", "x")]
    spark.createDataFrame(rows, "id bigint, matn string, chapter string").write.parquet(f"{tmp_path}/hadith.parquet")
    got = {(r["id"], r["bucket"]): r["x"] for r in queries.hash_embed(spark, str(tmp_path)).collect()}
    dense = spark.createDataFrame([(i, (m or "").split()) for i, m, _ in rows], "id bigint, w array<string>").select("id", F.posexplode(search.hash_embedding(F.col("w"))).alias("bucket", "x"))
    assert got == {(r["id"], r["bucket"]): round(r["x"], 6) for r in dense.where("x > 0").collect()} and {i for i, _ in got} == {1, 2}
