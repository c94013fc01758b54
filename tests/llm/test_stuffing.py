"""Line shapes and pages, on texts made for each kind and on prose that looks like it."""

import random

import pytest

from corpuschain.llm import stuffing

PROSE = "The careful scribe records the village against the source, and the page follows it. No chain removes the short passage that the paper describes. The younger verdict precedes the catalogue of every library in the town."
RNG = random.Random(4)
WORDS = ["river", "chain", "market", "best price", "letter", "cheap book", "garden"]


def chosen(n, sep):
    return sep.join(RNG.choice(WORDS) for _ in range(n))


SPAM = {
    "pipes": chosen(40, " | "), "commas": chosen(40, ", "), "arabic commas": "، ".join(["كتاب نهر", "باب", "جبل قرية"] * 15),
    "dashes": " - ".join(["best river in town", "best book in river"] * 15), "lines": chosen(40, "\n"), "run": chosen(60, " "),
    "links": "\n".join(f"https://a{i}.example/x/y" for i in range(12)), "anchors": " ".join(f"[word {i}](http://b{i}.test/q)" for i in range(12)),
    "bare": "\n".join(f"name - c{i}.example/path" for i in range(12)), "tags": " ".join(f"#river_{i}" for i in range(30)),
    "menu": "\n".join(" | ".join(RNG.sample(["a1", "bb", "cc", "dd", "ee", "ff"], 6)) + " http://x.test/y" for _ in range(8)),
    "many shapes": "\n".join(sep.join((w.title() if n % 3 else w) for w in (WORDS * 3)[: 2 + n % 9]) + (" |" if n % 2 else " · x") for n, sep in enumerate([" | ", ", ", " · ", "; "] * 8)),
    "after a sentence": "A short sentence stands here.\n" + chosen(60, " | "),
}
HARMLESS = {
    "prose": PROSE, "links after prose": PROSE + "\n" + "\n".join(f"http://a{i}.example/x" for i in range(4)),
    "references": PROSE + "\n" + "\n".join(f"{i}. Author {i}, the book of the {w}, 19{i}0" for i, w in enumerate(["river", "town", "hill", "wood", "field", "sea"], 1)),
    "contents": PROSE + "\n" + "\n".join(f"The {w} of the river ..... {i}" for i, w in enumerate(WORDS * 3)),
    "refrain": "\n".join([PROSE.split(". ")[0] + ".", "the early variant repeats the old refrain beside the folio"] * 6),
    "tiny": "see note", "few links": "http://a.test/x", "empty": "", "null": None, "blank": " \n \n", "marks": "?! ... —",
}


@pytest.mark.parametrize("name", SPAM)
def test_spam(name):
    flagged, share, *_ = stuffing.page(SPAM[name])
    assert flagged and share >= 0.5


@pytest.mark.parametrize("name", HARMLESS)
def test_harmless(name):
    assert not stuffing.page(HARMLESS[name])[0]


def test_same_after_odd_spaces_and_marks():
    text = SPAM["arabic commas"]
    assert stuffing.page(text.replace(" ", " ").replace("ب", "بَ‌")) == stuffing.page(text)


def test_operator(spark):
    rows = [(i, t, "x") for i, t in enumerate([*SPAM.values(), *HARMLESS.values(), PROSE * 5000, SPAM["pipes"] * 3000])]
    df = spark.createDataFrame([*rows, rows[0]], "doc_id bigint, text string, flagged string")
    got = [(r["doc_id"], r["flagged"]) for r in stuffing.pages(df, "doc_id", "text").collect()]
    n = len(SPAM)
    assert sorted(i for i, f in got if f) == [0, *range(n), len(rows) - 1]
    assert len(got) == len(rows) + 1
    assert stuffing.pages(df.limit(0), "doc_id", "text").count() == 0
