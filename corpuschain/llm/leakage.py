"""Evaluation texts leaking into training text, by winnowing.

Texts become sequences of folded words (no case, vowel marks, spelling variants of a
letter, punctuation, markup or odd coding).  Of every ``window`` consecutive hashes of
``k`` words the smallest is kept, so that two texts that share ``k + window - 1`` words in
a row share a fingerprint.  The fingerprints of the corpus and of the evaluation items are
tables that are joined, and every hit is extended in both directions by a banded local
alignment that passes over single changed, missing or added words.

Neither side is collected.  The corpus is read once: its fingerprints pass a bitmap of
those of the items (of bounded size, whatever the number of items), so that only documents
with a fingerprint in it, and of these only such fingerprints, are written and shuffled.
The joins are salted, so that a passage or an item that stands in a third of all documents
meets many tasks.

Instructions that open or end several *different* items are stock and no evidence; copies
and light variants of one item count once, and a shared run longer than an instruction is a passage.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuschain.functions.text import FOLD_FROM, FOLD_TO
from corpuschain.llm.visual import DIGITS, LOOK_ALIKES, _prints_as
from corpuschain.runtime import Scratch

#: Spelling variants of Arabic letters, hamza and kashida dropped.
SPELLINGS = dict(zip(FOLD_FROM, FOLD_TO)) | {"ء": "", "ـ": ""}
_TAG = re.compile(r"<[^<>]{0,200}>|&(?:#\d{1,6}|#[xX][0-9a-fA-F]{1,5}|[A-Za-z]{2,8});")
_LINKED = re.compile(r"\]\([^)\s]*\)")


def _fold(ch: str) -> str:
    ch = _prints_as(ch)
    out = []
    for c in unicodedata.normalize("NFKD", ch):
        c = DIGITS.get(c) or LOOK_ALIKES.get(c, c)[:1] or c
        if unicodedata.category(c)[0] == "M":
            continue
        c = unicodedata.normalize("NFC", c)
        c = SPELLINGS.get(c, c)
        if c.isdecimal():
            c = str(unicodedata.decimal(c))
        out.append(c.casefold() if not c or c.isalnum() else " ")
    return "".join(out)


class _Folds(dict):
    def __missing__(self, code: int) -> str:
        self[code] = _fold(chr(code))
        return self[code]


_FOLDS = _Folds()
# A mark that joins a letter outside the tables is dropped with the others.
_FOLDS[0x27] = _FOLDS[0x2019] = ""


def words(text: str) -> list[str]:
    """The folded words of a text."""
    if "<" in text or "&" in text:
        text = _TAG.sub(" ", text)
    if "](" in text:
        text = _LINKED.sub("] ", text)
    return text.translate(_FOLDS).split()


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = xxhash.xxh64_intdigest(word)
        return self[word]


def hashed(tokens: list[str], memo: _Hashes) -> np.ndarray:
    return np.fromiter(map(memo.__getitem__, tokens), dtype=np.uint64, count=len(tokens))


_BASE = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(w: np.ndarray, k: int) -> np.ndarray:
    """The hash of each k consecutive words."""
    if len(w) < k:
        return np.empty(0, dtype=np.uint64)
    h = np.zeros(len(w) - k + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            h = h * _BASE + w[i : len(w) - k + 1 + i]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return h


def winnow(h: np.ndarray, window: int) -> np.ndarray:
    """Positions of the (rightmost) smallest hash of each window; of a shorter sequence, the smallest of all."""
    if not len(h):
        return np.empty(0, dtype=np.int64)
    window = min(window, len(h))
    views = np.lib.stride_tricks.sliding_window_view(h, window)
    at = np.arange(len(views)) + (window - 1 - np.argmin(views[:, ::-1], axis=1))
    return np.unique(at)


@dataclass(frozen=True)
class Settings:
    """k and window of winnowing; a hit counts from ``least`` matched words that are not stock, in a passage of ``passage`` words or more of which ``agree`` match.

    Every shared run of k + window - 1 words is found, so a passage of 20 words with any two single changes is.

    ``stock_items``: a run of words at the edge of so many different items, of ``stock_edge`` words at
    most, is stock instruction; items of which ``copy`` of the runs are equal are one item.
    ``bits``: the bitmap of fingerprints has 2 to the power of this at most.  ``salts``: parts of a hot key.
    """

    k: int = 5
    window: int = 2
    least: int = 15
    passage: int = 19
    agree: float = 0.75
    stock_items: int = 3
    stock_edge: int = 30
    copy: float = 0.4
    bits: int = 26
    salts: int = 8


def row_number() -> Iterator[int]:
    """Numbers that no other task of the stage gives out."""
    context = TaskContext.get()
    start = (context.partitionId() if context else 0) << 36
    while True:
        yield start
        start += 1


def words_of(df: DataFrame, key: str, text: str) -> DataFrame:
    """(n, key, w): the hashed words of each text that has any, under a row number."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, memo = row_number(), _Hashes()
        for b in batches:
            own = [hashed(words(t), memo).tobytes() for t in b["t"]]
            yield pd.DataFrame({"n": [next(number) for _ in own], "key": b["key"], "w": own})

    narrow = df.select(F.col(key).cast("bigint").alias("key"), F.col(text).cast("string").alias("t")).where(F.col("t").isNotNull())
    return narrow.mapInPandas(run, "n bigint, key bigint, w binary").where(F.length("w") > 0)


def unpack(w: bytes) -> np.ndarray:
    return np.frombuffer(w, dtype=np.uint64)


def runs(items: DataFrame, s: Settings) -> DataFrame:
    """(n, h, edge): each run of k words of each item, and whether it lies near the item's beginning or end."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for n, w in zip(b["n"], b["w"], strict=True):
                h = shingle_hashes(unpack(w), s.k)
                at = np.arange(len(h))
                yield pd.DataFrame({"n": n, "h": h.view(np.int64), "edge": (at < s.stock_edge) | (at >= len(h) - s.stock_edge)})

    return items.select("n", "w").mapInPandas(run, "n bigint, h bigint, edge boolean")


def stock_runs(items: DataFrame, scratch: Scratch, s: Settings) -> DataFrame:
    """(h): the runs near the edges of ``stock_items`` or more different items.

    Copies and variants of an item meet in a star: each item is compared with the first item that
    has the same run, for each of its runs, so a run that all items share makes no pairs of all with all.
    """
    seen = scratch.cut(runs(items, s).groupBy("n", "h").agg(F.max("edge").alias("edge")), "runs")
    hubs = seen.groupBy("h").agg(F.min("n").alias("hub"), F.count(F.lit(1)).alias("held")).where("held > 1").select("h", "hub")
    size = seen.groupBy("n").agg(F.count(F.lit(1)).alias("size"))
    shared = seen.join(hubs, "h").where("n <> hub").groupBy("n", "hub").agg(F.count(F.lit(1)).alias("shared"))
    sized = shared.join(size, "n").join(size.select(F.col("n").alias("hub"), F.col("size").alias("hub_size")), "hub")
    near = sized.where(F.col("shared") >= s.copy * F.greatest("size", "hub_size")).groupBy("n").agg(F.min("hub").alias("first"))
    one = scratch.cut(near, "copies")
    family = one.join(one.select(F.col("n").alias("first"), F.col("first").alias("earlier")), "first", "left").select("n", F.coalesce("earlier", "first").alias("family"))
    edges = seen.where("edge").join(family, "n", "left").select("h", F.coalesce("family", "n").alias("family"))
    return edges.groupBy("h").agg(F.countDistinct("family").alias("families")).where(F.col("families") >= s.stock_items).select("h")


def stock_mask(w: np.ndarray, shared: np.ndarray, s: Settings) -> np.ndarray:
    """Which words of an item are stock: the shared runs that reach its very edge, but for single words before or between them, and are no longer than ``stock_edge``."""
    flag = np.zeros(len(w), dtype=bool)
    for i in np.flatnonzero(np.isin(shingle_hashes(w, s.k), shared)):
        flag[i : i + s.k] = True
    keep = np.zeros(len(w), dtype=bool)
    for step, start in ((1, 0), (-1, len(w) - 1)):
        reached, missed, i = [], 0, start
        while 0 <= i < len(w) and missed <= 1:
            missed = 0 if flag[i] else missed + 1
            if flag[i]:
                reached.append(i)
            i += step
        if len(reached) <= s.stock_edge:
            keep[reached] = True
    return keep


ITEM = "n bigint, key bigint, w binary, stock binary, whole boolean, prints array<bigint>, places array<int>"


def fingerprinted(items: DataFrame, stock: DataFrame, s: Settings) -> DataFrame:
    """Items with their stock words and the fingerprints that lead to them; ``whole``: too short for a passage, so that only the whole item counts."""
    own = runs(items, s).select("n", "h").distinct().join(stock, "h").groupBy("n").agg(F.collect_list("h").alias("shared"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for n, key, packed, shared in zip(b["n"], b["key"], b["w"], b["shared"], strict=True):
                w = unpack(packed)
                mask = stock_mask(w, np.array([] if shared is None else shared, dtype=np.int64).view(np.uint64), s)
                left = int((~mask).sum())
                if not left:
                    continue
                whole = left < s.least
                h = shingle_hashes(w, min(s.k, len(w)))
                at = np.array([0]) if whole else winnow(h, s.window)
                if not whole:
                    at = at[[not mask[i : i + s.k].all() for i in at]]
                out.append((n, key, packed, mask.tobytes(), whole, h[at].view(np.int64), at))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in ITEM.split(", ")])

    return items.join(own, "n", "left").mapInPandas(run, ITEM)


class Sieve:
    """A bitmap of fingerprints, each under two of its bits; two bitmaps, for passages and for whole items."""

    def __init__(self, prints: DataFrame, n: int, most: int):
        self.bits = min(most, max(16, (32 * n).bit_length()))
        self.maps = np.zeros((2, 1 << self.bits), dtype=bool)
        mask = F.lit((1 << self.bits) - 1)
        slot = F.explode(F.array(F.col("h").bitwiseAND(mask), F.shiftrightunsigned("h", 32).bitwiseAND(mask))).alias("slot")
        packed = prints.select("whole", slot).groupBy("whole", F.floor(F.col("slot") / 64).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(slot % 64 AS INT))")).alias("set"))
        rows = packed.toPandas()  # at most 2^bits / 64 rows of each kind
        for kind in (False, True):
            own = rows[rows["whole"] == kind]
            if len(own):
                set_ = np.unpackbits(own["set"].to_numpy(dtype=np.int64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                self.maps[int(kind)].reshape(-1, 64)[own["at"].to_numpy(dtype=np.int64)] = set_.astype(bool)

    def has(self, h: np.ndarray, whole: bool) -> np.ndarray:
        mask, bits = np.uint64((1 << self.bits) - 1), self.maps[int(whole)]
        found = bits[(h & mask).astype(np.int64)]
        found[found] = bits[((h[found] >> np.uint64(32)) & mask).astype(np.int64)]
        return found


def align(d: np.ndarray, a: np.ndarray, stock: np.ndarray, shift: int, band: int = 12) -> tuple[int, int, int, int, int, int]:
    """Banded local alignment of an item to a document near the diagonal ``document - item = shift``.

    A match scores 1, a changed, missing or added word -2.  Returns (matched words that are not
    stock, matched words, item start, item end, document start, document end) of the best passage.
    """
    n, width = len(a), 2 * band + 1
    low, miss = shift - band, -2
    # states hold (score, matched, matched that are no stock, item start, document start)
    nothing = (0, 0, 0, -1, -1)
    above: list[tuple] = [nothing] * (width + 1)
    best, where = nothing, (0, 0)
    eq_at: dict[int, list[int]] = {}
    from_, to = max(0, low), min(len(d), low + n + width)
    for j in range(from_, to):
        eq_at.setdefault(int(d[j]), []).append(j)
    for i in range(n):
        here: list[tuple] = [nothing] * (width + 1)
        equal = eq_at.get(int(a[i]), ())
        left = nothing
        hits = {j - low - i for j in equal}
        for b in range(width):
            cell = above[b]  # diagonal: item i-1, document j-1 lies at the same offset
            if b in hits:
                own = 0 if stock[i] else 1
                cell = (cell[0] + 1, cell[1] + 1, cell[2] + own, cell[3], cell[4]) if cell[0] > 0 else (1, 1, own, i, low + i + b)
            elif cell[0] > -miss:
                cell = (cell[0] + miss, *cell[1:])
            else:
                cell = nothing
            up = above[b + 1]  # a word of the item is missing in the document
            if up[0] + miss > cell[0]:
                cell = (up[0] + miss, *up[1:])
            if left[0] + miss > cell[0]:  # the document has a word more
                cell = (left[0] + miss, *left[1:])
            here[b] = left = cell
            if cell[0] > best[0]:
                best, where = cell, (i + 1, low + i + b + 1)
        above = here
    return best[2], best[1], best[3], where[0], best[4], where[1]


def past_single_changes(d: np.ndarray, a: np.ndarray, stock: np.ndarray, passage: tuple) -> tuple:
    """The passage with what lies beyond one changed word at either end, which the alignment's scores give up."""
    own, matched, a0, a1, d0, d1 = passage
    while matched and min(a0, d0) > 0:
        step = 1 if a[a0 - 1] == d[d0 - 1] else 2
        if min(a0, d0) < step or a[a0 - step] != d[d0 - step]:
            break
        a0, d0 = a0 - step, d0 - step
        own, matched = own + (not stock[a0]), matched + 1
    while matched and a1 < len(a) and d1 < len(d):
        step = 0 if a[a1] == d[d1] else 1
        if a1 + step >= len(a) or d1 + step >= len(d) or a[a1 + step] != d[d1 + step]:
            break
        own, matched = own + (not stock[a1 + step]), matched + 1
        a1, d1 = a1 + step + 1, d1 + step + 1
    return int(own), matched, a0, a1, d0, d1


def compare(d: np.ndarray, a: np.ndarray, stock: np.ndarray, shifts: list[int], s: Settings) -> tuple | None:
    """The best passage of an item in a document, from where its fingerprints meet (document place less item place); None where too little matches."""
    best = None
    left = sorted(shifts)
    own_words = a[~stock].tolist()
    while left:
        group = [x for x in left if x - left[0] <= 12]
        left = left[len(group) :]
        shift = group[len(group) // 2]
        near = set(d[max(0, shift - 12) : max(0, shift + len(a) + 12)].tolist())
        if sum(w in near for w in own_words) < s.least:
            continue
        own, matched, a0, a1, d0, d1 = past_single_changes(d, a, stock, align(d, a, stock, shift))
        span = max(a1 - a0, d1 - d0, 1)
        if own >= s.least and span >= min(s.passage, len(a)) and matched >= s.agree * span and (best is None or own > best[0]):
            best = (own, matched, a0, a1, d0, d1)
    return best


def whole_item(d: np.ndarray, a: np.ndarray, stock: np.ndarray, shifts: list[int], s: Settings) -> tuple | None:
    """The item word for word in the document; one of under k words only where the document is nothing else."""
    for at in sorted(shifts):
        if 0 <= at and at + len(a) <= len(d) and (d[at : at + len(a)] == a).all() and (len(a) >= s.k or len(a) == len(d)):
            return int((~stock).sum()), len(a), 0, len(a), at, at + len(a)
    return None


HITS = "n_words bigint, n_matched bigint, item_from bigint, item_to bigint, doc_from bigint, doc_to bigint"


def leaks(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, settings: Settings = Settings()) -> DataFrame:
    """One row for each document and item of which it holds the whole or a long passage, with the places in words.

    Null and empty texts on either side match nothing.  Items of which under ``least`` words are not stock
    match where they stand word for word as a whole, those of under k words only as a whole document;
    items that are stock from end to end match nothing.  Repeated document or item ids give a row
    for each row; other columns are ignored.  Stock is found over all items.
    """
    s = settings
    scratch = Scratch(docs.sparkSession, "leakage")
    read = scratch.cut(words_of(items, item_id, item_text), "items")
    stock = scratch.cut(stock_runs(read, scratch, s), "stock")
    kept = scratch.cut(fingerprinted(read, stock, s), "fingerprints")
    prints = kept.select("n", "whole", F.explode(F.arrays_zip("prints", "places")).alias("p")).select("n", "whole", F.col("p.prints").alias("h"), F.col("p.places").alias("item_at"))
    n_prints = kept.agg(F.sum(F.size("prints"))).first()[0] or 0
    sieve = docs.sparkSession.sparkContext.broadcast(Sieve(prints.select("whole", "h"), n_prints, s.bits))
    kind = dict(docs.dtypes)[doc_id]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, memo, maps = row_number(), _Hashes(), sieve.value
        for b in batches:
            out = []
            for key, t in zip(b["key"], b["t"], strict=True):
                w = hashed(words(t), memo)
                h = shingle_hashes(w, min(s.k, len(w))) if len(w) else w
                whole = np.flatnonzero(maps.has(h, True))
                maybe = np.flatnonzero(maps.has(h, False)) if len(w) >= s.k else whole[:0]
                part = np.intersect1d(maybe, winnow(h, s.window), assume_unique=True) if len(maybe) else maybe
                if len(part) or len(whole):
                    at = np.concatenate([part, whole])
                    out.append((next(number), key, w.tobytes(), h[at].view(np.int64), at, np.arange(len(at)) >= len(part)))
            yield pd.DataFrame(out, columns=["d", "key", "w", "prints", "places", "whole"])

    narrow = docs.select(F.col(doc_id).alias("key"), F.col(text).cast("string").alias("t")).where(F.col("t").isNotNull())
    met = scratch.cut(narrow.mapInPandas(scan, f"d bigint, key {kind}, w binary, prints array<bigint>, places array<int>, whole array<boolean>"), "documents")
    salt = F.pmod(F.xxhash64("d"), F.lit(s.salts)).cast("int").alias("salt")
    every = F.explode(F.sequence(F.lit(0), F.lit(s.salts - 1))).alias("salt")
    marks = met.select("d", salt, F.explode(F.arrays_zip("prints", "places", "whole")).alias("p"))
    marks = marks.select("d", "salt", F.col("p.prints").alias("h"), F.col("p.places").alias("doc_at"), F.col("p.whole").alias("whole"))
    seeds = marks.join(prints.select("*", every), ["h", "whole", "salt"]).groupBy("d", "salt", "n").agg(F.collect_set(F.col("doc_at") - F.col("item_at")).alias("shifts"))
    sides = seeds.join(kept.select("n", F.col("key").alias("item_id"), F.col("w").alias("item_w"), "stock", "whole", every), ["n", "salt"]).join(met.select("d", "key", "w"), "d")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for key, item, w, a, mask, whole, shifts in zip(b["key"], b["item_id"], b["w"], b["item_w"], b["stock"], b["whole"], b["shifts"], strict=True):
                judge = whole_item if whole else compare
                if hit := judge(unpack(w), unpack(a), np.frombuffer(mask, dtype=bool), shifts.tolist(), s):
                    out.append((key, item, *hit))
            yield pd.DataFrame(out, columns=["d", "item_id", *(c.split()[0] for c in HITS.split(", "))])

    found = sides.select("key", "item_id", "w", "item_w", "stock", "whole", "shifts").mapInPandas(verify, f"d {kind}, item_id bigint, {HITS}")
    return found.withColumnRenamed("d", doc_id)


def leaked_items(hits: DataFrame, items: DataFrame, item_id: str) -> DataFrame:
    """For each item: the number of documents that hold it, and the most words of it that one holds; 0 where none does."""
    per_item = hits.groupBy(F.col("item_id").alias("_i")).agg(F.count(F.lit(1)).alias("n_documents"), F.max("n_words").alias("most_words"))
    return items.select(item_id).join(per_item, F.col(item_id) == F.col("_i"), "left").select(
        item_id, F.coalesce("n_documents", F.lit(0)).alias("n_documents"), F.coalesce("most_words", F.lit(0)).alias("most_words")
    )

