"""Survivorship against a plain sort."""

import datetime as dt
import random

from pyspark.sql import functions as F

from corpuschain.llm import survivor

SCHEMA = "entry_id bigint, person_no bigint, name string, grade_text string, opinions array<struct<source:string,grade:string>>, source string, revised_at timestamp, value string, t int"
BOOKS = [("Big Book", ["BB", "The Big"], 1), ("Small Book", ["SB"], 2), ("No Trust", ["NT"], None), ("Later", None, 3)]


def books(spark):
    return spark.createDataFrame(BOOKS, "source string, short_titles array<string>, trust int")


def found(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    out = survivor.surviving_entries(survivor.surviving_records(df, books(spark)))
    return {(r["person_no"], r["field"]): r["entry_id"] for r in out.collect()}


def test_usable(spark):
    good = ["متقن", "A b", "ماذز بن زبنان [؟]", "x", "مُتْقِن", "Ça va", "Müller"]
    bad = [None, "", "  ", " ", "...", "-", "--", "؟", "?", "n/a", "NULL", " لا  يوجد ", "مت�ن", "م???ن", "????", "Ø§Ù„Ø±Ù…", "لَمْ يُذكر", "12"]
    df = spark.createDataFrame([(v,) for v in good + bad], "v string")
    got = [r["u"] for r in df.select(survivor.usable(F.col("v")).alias("u")).collect()]
    assert got == [True] * len(good) + [False] * len(bad)


def test_order_of_preference(spark):
    day = dt.datetime(2024, 1, 1)
    rows = [
        (1, 1, "a b c [d e f g]", "x", [("s", "g"), ("s", "g"), ("s", "-")], "unheard", day),
        (2, 1, "a b c d", "-", [("s", "g"), ("s", "h")], " bb ", None),
        (3, 1, "a b c d", "y", None, "SMALL   book", day),
        (4, 1, "d c b a", "z", [("s", "g"), ("r", "g")], "the big", day),
        (5, 1, "d c b a", "z", [], "THE BIG", day),
        (6, 2, "a", None, None, "NT", None),
        (7, 2, "?", None, [("s", "?")], "NT", None),
        (8, 3, "alone", "x", None, "BB", day),
        (9, None, "a", "x", None, "BB", day), (10, None, "b", "x", None, "BB", day),
    ]
    assert found(spark, rows) == {
        (1, "name"): 4, (1, "grade_text"): 4, (1, "opinions"): 4, (1, "source"): 4, (2, "name"): 6,
    }


def test_against_sorting(spark):
    rng = random.Random(3)
    names = ["a b", "a b c", "-", None, "a [x y z]", "a�b"]
    sources = ["BB", "sb", None, "who", "later", " small  BOOK"]
    days = [None, dt.datetime(2024, 1, 1), dt.datetime(2023, 1, 1)]
    rows = [(i, rng.randrange(40), rng.choice(names), rng.choice(["g", "", "n/a"]), None, rng.choice(sources), rng.choice(days)) for i in range(200)]
    trust = {"BB": 1, "sb": 2, " small  BOOK": 2, "later": 3}
    words = {"a b": 2, "a b c": 3, "a [x y z]": 1}
    want = {}
    for p in {r[1] for r in rows}:
        own = [r for r in rows if r[1] == p]
        if len(own) < 2:
            continue
        tie = lambda r: (trust.get(r[5], 99), -(r[6].timestamp() if r[6] else -1), r[0])
        for field, key, ok in (
            ("name", lambda r: -words[r[2]], lambda r: r[2] in words),
            ("grade_text", lambda r: 0, lambda r: r[3] == "g"),
            ("source", lambda r: 0, lambda r: r[5] in trust),
        ):
            if left := [r for r in own if ok(r)]:
                want[p, field] = min(left, key=lambda r: (key(r), *tie(r)))[0]
    assert found(spark, rows) == want


def test_empty(spark):
    assert found(spark, []) == {}
