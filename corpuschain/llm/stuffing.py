"""Keyword-stuffed and link-list pages, by the shapes of their lines.

Each line is reduced to a shape: its kind and its counts of words, capitals, separators
and links, in coarse steps.  A page is grouped by shape.  It is flagged where the shapes of one
kind that isn't a sentence, or all such shapes together, hold at least half of what it says,
however many shapes they are: a long mixed list has many, a page of one repeated line has one.

Kinds that aren't sentences: lists (a separator for every few words), tags, links with
little text around them, lines of a few words without an end mark, and long runs of few
different words without any mark.  Entries of contents and of references are neither:
they don't count on either side.

A page is one row, so shapes are grouped inside the row; nothing is shuffled.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from corpuschain.llm.visual import _DIRECT

_LINK = re.compile(r"\[[^\]\n]*\]\([^)\s]*\)|(?:https?://|ftp://|www\.)\S+|(?<![\w@.])[\w-]+(?:\.[\w-]+)+/\S*|<a\s[^>]*>.*?</a>", re.I)
_ANCHOR = re.compile(r"\[([^\]\n]*)\]\([^)\s]*\)|<a\s[^>]*>(.*?)</a>", re.I)
_TAG = re.compile(r"<[^<>]*>")
_WORD = re.compile(r"[^\W_]+")
_ODD = re.compile(r"[^\x09\x0a\x0d\x20-\x7e\u00a1-\u00ac\u00ae-\u05ff\u0600-\u061b\u061d-\u06ff\u2010-\u2027]")
_VOWELLED = re.compile("[\u0640\u064b-\u0652]")
_SEPARATOR = re.compile(r"[|,،;؛•·»>→#*/\\_]+|\s[-–—]\s|\s:\s")
_END = re.compile(r"[.!?؟۔。…:](?=\s|$|[\"»”)])")
_HASHTAG = re.compile(r"#[^\s#]+")
#: Leader dots or a wide gap before a page number.
_CONTENTS = re.compile(r"^.*\S\s*(?:\.{3,}|…+|(?:\. ){3,}|_{3,}|\t)\s*[\d٠-٩]+\s*\.?$")
#: A numbered entry: "3. Author, title, 1998".
_REFERENCE = re.compile(r"^\s*(?:\[?[\d٠-٩]{1,3}[\]).\-:]|[-•*]\s+(?=.*[\d٠-٩]))\s*\S")
_MARKS = {c: None for c in [*range(0x610, 0x61B), 0x640, *range(0x64B, 0x660), 0x670]}

#: How many words a link weighs, words up to which a line is short, words from which a
#: run without marks is judged by its different words, and the share of those.
LINK_WORDS, SHORT, RUN, RUN_DISTINCT = 3, 4, 20, 0.45
#: Words for each separator in a list at most.
LIST_WORDS = 5.5
#: The share of a page that such shapes must hold, and the least weight of a page.
SHARE, LEAST = 0.5, 20

SENTENCE, APPARATUS = "sentence", "apparatus"


def _step(n: int) -> int:
    return min(n.bit_length(), 6)


def line_shape(line: str) -> tuple[str, int]:
    """(shape, weight in words) of one line that is not blank."""
    links = _LINK.findall(line) if "/" in line or "www." in line or "](" in line else ()
    anchors = sum(len(_WORD.findall((a or b))) for a, b in _ANCHOR.findall(line)) if links else 0
    rest = _LINK.sub(" | ", line) if links else line
    tags = len(_HASHTAG.findall(rest)) if "#" in rest else 0
    words = _WORD.findall(rest)
    n = len(words) + anchors
    weight = n + LINK_WORDS * len(links)
    ends = len(_END.findall(rest))
    separators = len(_SEPARATOR.findall(rest))
    if not links and not tags:
        if line.rstrip(" .")[-1:].isdigit() and _CONTENTS.match(line):
            return APPARATUS, weight
        if n > 3 and _REFERENCE.match(line) and ("، " in line or ", " in line or "“" in line):
            return APPARATUS, weight
    if links and n <= LINK_WORDS * len(links) + SHORT:
        kind = "links"
    elif tags and 2 * tags >= min(n, len(rest.split())):
        kind = "tags"
    elif n >= 3 and separators and n <= LIST_WORDS * separators and ends * 8 <= n:
        kind = "list"
    elif n <= SHORT and not ends:
        kind = "short"
    elif n >= RUN and len({w.lower() for w in words}) < RUN_DISTINCT * n and ends * 25 <= n and separators * 12 <= n:
        kind = "run"
    else:
        return SENTENCE, weight
    capitals = sum(w[0].isupper() for w in words)
    return f"{kind}:{_step(n)}:{4 * capitals // max(1, len(words))}:{_step(separators)}:{_step(len(links))}", weight


def page(text: str | None) -> tuple[bool, float, str, int]:
    """(flagged, share of the shapes that aren't sentences, the heaviest kind of them, weight of the page)."""
    shapes: Counter[str] = Counter()
    text = text or ""
    text = text.translate(_DIRECT) if _ODD.search(text) else text
    text = text.translate(_MARKS) if _VOWELLED.search(text) else text
    for line in text.splitlines():
        line = _TAG.sub(" ", line) if "<" in line and "<a " not in line else line
        if line.strip():
            shape, weight = line_shape(line)
            shapes[shape] += weight
    shapes.pop(APPARATUS, None)
    total = sum(shapes.values())
    kinds: Counter[str] = Counter()
    for shape, weight in shapes.items():
        if shape != SENTENCE:
            kinds[shape.split(":")[0]] += weight
    share = sum(kinds.values()) / total if total else 0.0
    return total >= LEAST and share >= SHARE, share, kinds.most_common(1)[0][0] if kinds else SENTENCE, total


def pages(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, flagged, share, kind, weight) for each row.

    Null, empty and very short texts are not flagged; whole texts are judged, however long.
    Rows with the same key are judged each; other columns are ignored.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [page(t) for t in batch["t"]]
            yield pd.DataFrame({"k": batch["k"], "flagged": [o[0] for o in out], "share": [round(o[1], 6) for o in out], "kind": [o[2] for o in out], "weight": [o[3] for o in out]})

    kind = dict(df.dtypes)[key]
    judged = df.selectExpr(f"`{key}` AS k", f"`{text}` AS t").mapInPandas(run, f"k {kind}, flagged boolean, share double, kind string, weight bigint")
    return judged.withColumnRenamed("k", key)
