"""Visually identical text in one consistent form.

1. Ignorable characters (Unicode format characters, variation selectors, fillers) go.
2. Compatibility forms that print like an ordinary character (full width, Arabic
   presentation forms, typographic ligatures, special spaces) become that character,
   and the result is composed (NFC).  Signs that show in print, such as "…", "\u00bd" or
   U+FFFD, stay.
3. Letters that merely look like others become a lattice: each position of a token
   offers its own character and those that print alike.  Viterbi search takes the path
   with the best score under a character trigram model of the whole table, with a charge
   for each change of script inside a token, so that a Cyrillic "о" becomes Latin in
   "vоl" and stays in a Russian word, and a Farsi yeh becomes yeh or alef maksura,
   whichever the corpus writes there.

The trigram counts are summed over all values of all rows.  Their number is bounded by
the alphabet of the model (``SYMBOLS`` cubed), not by the data, so they are collected and
sent to the tasks.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Characters beside Unicode's Cf that print nothing.
FILLERS = "\u034fᅟᅠ\u17b4\u17b5\u180b\u180c\u180d\u180e\u180fㅤ\uffa0"
# Letters that print like an ordinary one, and what they print like.
LOOK_ALIKES = {
    # Cyrillic
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S",
    "ԍ": "G", "ѵ": "v",
    # Greek
    "ο": "o", "ν": "v", "α": "a", "ι": "i", "ρ": "p", "υ": "u", "κ": "k", "χ": "x", "γ": "y",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    # Armenian and others
    "օ": "o", "ս": "u", "հ": "h", "ո": "n", "ց": "g", "\u0131": "i", "ɡ": "g", "ɑ": "a", "ꞌ": "'",
    # Arabic letters of other languages; some print like two letters, by place
    "ک": "ك", "ڪ": "ك", "ی": "يى", "ې": "ي", "ے": "ي", "ۍ": "يى", "ھ": "ه", "ہ": "ه", "ە": "ه", "ۀ": "ة", "ۃ": "ة", "ٱ": "ا", "ٲ": "أ", "ٳ": "إ",
}
# Digits that print alike in any context.
DIGITS = {"۰": "٠", "۱": "١", "۲": "٢", "۳": "٣", "۷": "٧", "۸": "٨", "۹": "٩"}
# Sequences that print like one letter and that NFC leaves alone.
SEQUENCES = {"ى\u0654": "ئ", "ی\u0654": "ئ", "ں\u0654": "ن\u0654"}
FOLDED_TAGS = ("<wide>", "<narrow>", "<isolated>", "<initial>", "<medial>", "<final>", "<font>", "<noBreak>")
LIGATURES = "ﬀﬁﬂﬃﬄﬅﬆ"

ARABIC = "ءآأؤإئابةتثجحخدذرزسشصضطظعغفقكلمنهوىي"
LATIN = "abcdefghijklmnopqrstuvwxyz"
#: 0 is the edge of a token, 1 a digit, 2 any other letter; then the ordinary letters.
SYMBOLS = 3 + len(ARABIC) + len(LATIN)
EDGE, DIGIT, OTHER = 0, 1, 2


def _prints_as(ch: str) -> str:
    """What a single character becomes before the lattice: itself, its ordinary form, or nothing."""
    if ch in FILLERS or 0xFE00 <= ord(ch) <= 0xFE0F or 0xE0100 <= ord(ch) <= 0xE01EF or unicodedata.category(ch) == "Cf":
        return ""
    if unicodedata.category(ch) == "Zs":
        return " "
    if ch in DIGITS:
        return DIGITS[ch]
    tag, _, rest = unicodedata.decomposition(ch).partition(" ")
    word_sign = 0xFDF0 <= ord(ch) <= 0xFDFF  # one printed sign for a whole phrase
    if (tag in FOLDED_TAGS and not word_sign) or ch in LIGATURES:
        return unicodedata.normalize("NFKC", ch)
    return ch


class _Direct(dict):
    """``_prints_as`` for ``str.translate``, filled in as characters come."""

    def __missing__(self, code: int) -> str:
        self[code] = _prints_as(chr(code))
        return self[code]


_DIRECT = _Direct()


def suspect_pattern() -> str:
    """Java regex that every value to be changed matches, and few others.

    It finds any character outside the ordinary ones below, vowel marks in another order
    than NFC's (their canonical classes ascend with their code points), and a mark after
    a letter outside Arabic.
    """
    ordinary = r"\x{9}\x{a}\x{d}\x{20}-\x{7e}\x{ab}\x{bb}\x{c0}-\x{17f}\x{60c}\x{61b}\x{61f}\x{621}-\x{63a}\x{640}-\x{652}\x{660}-\x{669}\x{2010}\x{2012}-\x{2014}\x{2018}-\x{201d}\x{2026}\x{fffd}"
    disorder = "|".join(rf"\x{{{c:x}}}[\x{{64b}}-\x{{{c - 1:x}}}]" for c in range(0x64C, 0x653))
    return rf"[^{ordinary}]|{disorder}|[a-zA-Z\x{{c0}}-\x{{17f}}][\x{{64b}}-\x{{652}}]|\x{{131}}"


_TOKEN = re.compile(r"[^\W_](?:[^\W_]|[\u0610-\u061a\u0640\u064b-\u065f\u0670\u06d6-\u06ed\u0300-\u036f])*")
_ALIKE = re.compile("[" + "".join(LOOK_ALIKES) + "]")
_SEQUENCE = re.compile("|".join(SEQUENCES))


def plain_form(text: str) -> str:
    """Steps 1 and 2: everything that needs no context."""
    text = text.translate(_DIRECT)
    text = _SEQUENCE.sub(lambda m: SEQUENCES[m.group()], text)
    return unicodedata.normalize("NFC", text)


@lru_cache(maxsize=1)
def _symbol_of() -> np.ndarray:
    """Code point to symbol; -1 for what the model skips (marks, kashida), EDGE for what ends a token."""
    table = np.zeros(0x700, dtype=np.int16)
    for c in range(0x700):
        ch = chr(c)
        if unicodedata.category(ch)[0] == "M" or ch == "\u0640":
            table[c] = -1
        elif ch.isdigit():
            table[c] = DIGIT
        elif ch.isalpha():
            low = ch.lower()
            table[c] = 3 + ARABIC.index(ch) if ch in ARABIC else 3 + len(ARABIC) + LATIN.index(low) if low in LATIN else OTHER
    for ch in LOOK_ALIKES:
        if ord(ch) < 0x700:
            table[ord(ch)] = OTHER
    return table


def symbols(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    out = np.zeros(len(codes), dtype=np.int16)
    known = codes < 0x700
    out[known] = _symbol_of()[codes[known]]
    return out[out >= 0]


def count_trigrams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Trigram counts of all text columns; those with a look-alike or foreign letter teach nothing and stay out."""
    total = np.zeros(SYMBOLS**3, dtype=np.int64)
    for batch in batches:
        for column in batch.columns:
            joined = "  ".join(t for t in batch[column] if t)
            s = symbols(f"  {joined}  ").astype(np.int64)
            if len(s) < 3:
                continue
            a, b, c = s[:-2], s[1:-1], s[2:]
            # what stands before the edge of a token says nothing of its first letter
            a = np.where(b == EDGE, EDGE, a)
            known = (a != OTHER) & (b != OTHER) & (c != OTHER) & ~((b == EDGE) & (c == EDGE))
            total += np.bincount(((a * SYMBOLS + b) * SYMBOLS + c)[known], minlength=SYMBOLS**3)
    where = np.flatnonzero(total)
    yield pd.DataFrame({"code": where.astype(np.int64), "n": total[where]})


class Trigrams:
    """Smoothed log-probabilities of a symbol after two others, interpolated with bigrams and single symbols."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray):
        c3 = np.zeros(SYMBOLS**3)
        c3[codes] = counts
        c3 = c3.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
        c2, c1 = c3.sum(axis=0), c3.sum(axis=(0, 1))
        p1 = (c1 + 0.5) / (c1.sum() + 0.5 * SYMBOLS)
        p2 = (c2 + 5 * p1) / (c2.sum(axis=1, keepdims=True) + 5)
        p3 = (c3 + 5 * p2[None]) / (c3.sum(axis=2, keepdims=True) + 5)
        self.log = np.log(p3).astype(np.float32)


def _script(ch: str) -> str:
    c = ord(ch)
    if c < 0x250:
        return "latin"
    if 0x370 <= c < 0x400 or 0x1F00 <= c < 0x2000:
        return "greek"
    if 0x400 <= c < 0x530:
        return "cyrillic"
    if 0x530 <= c < 0x590:
        return "armenian"
    if 0x600 <= c < 0x780:
        return "arabic"
    return "other"


#: Log score of a change of script inside a token.
SWITCH = -30.0
#: Log score of keeping a letter for which an ordinary one prints alike: in a token that
#: has another letter of its script for which none does, and in one that has not.
KEEP_AMONG_OWN, KEEP_ALONE = 0.0, -200.0
#: Log score of a letter that the model doesn't know.
UNKNOWN = math.log(1e-3)


def own_scripts(token: str) -> set[str]:
    """Scripts other than Arabic and Latin of which the token has a letter that looks like no ordinary one."""
    return {_script(c) for c in token if c.isalpha() and c not in LOOK_ALIKES} - {"latin", "arabic"}


def keep(ch: str, own: set[str]) -> float:
    """The charge for keeping a character as it is."""
    if ch not in LOOK_ALIKES:
        return 0.0
    return KEEP_AMONG_OWN if _script(ch) in own else KEEP_ALONE


def search(token: str, model: Trigrams) -> str:
    """The best path through the look-alike lattice of one token, by Viterbi over (script, two symbols)."""
    table, first, own_here = _symbol_of(), (0.0, ""), own_scripts(token)
    paths: dict[tuple[str, int, int], tuple[float, str]] = {("", EDGE, EDGE): first}
    for ch in token:
        code = table[ord(ch)] if ord(ch) < 0x700 else OTHER
        if code < 0:
            paths = {k: (s, t + ch) for k, (s, t) in paths.items()}
            continue
        options = [(ch, keep(ch, own_here)), *((o, 0.0) for o in LOOK_ALIKES.get(ch, ""))]
        reached: dict[tuple[str, int, int], tuple[float, str]] = {}
        for (script, a, b), (score, text) in paths.items():
            for option, cost in options:
                own, sym = _script(option), int(table[ord(option)]) if ord(option) < 0x700 else OTHER
                gain = cost + (UNKNOWN if sym == OTHER else float(model.log[a, b, sym]))
                if sym == DIGIT:
                    own = script or own
                elif script not in ("", own):
                    gain += SWITCH
                key, new = (own, b, sym), (score + gain, text + option)
                if key not in reached or new[0] > reached[key][0]:
                    reached[key] = new
        paths = reached
    ends = ((s + float(model.log[a, b, EDGE]), t) for (_, a, b), (s, t) in paths.items())
    return max(ends, key=lambda x: (x[0], x[1]))[1]


def canonical(text: str, model: Trigrams, memo: dict[str, str]) -> str:
    """All three steps."""
    text = plain_form(text)
    if not _ALIKE.search(text):
        return text

    def settle(match: re.Match) -> str:
        token = match.group()
        if not _ALIKE.search(token):
            return token
        if token not in memo:
            if len(memo) > 200_000:
                memo.clear()
            memo[token] = search(token, model)
        return memo[token]

    return unicodedata.normalize("NFC", _TOKEN.sub(settle, text))


def learn(df: DataFrame, columns: Sequence[str]) -> Trigrams:
    """The model of all values of all rows; its counts are at most ``SYMBOLS`` cubed rows."""
    parts = df.select(*columns).mapInPandas(count_trigrams, "code bigint, n bigint")
    rows = parts.groupBy("code").agg(F.sum("n").alias("n")).toPandas()
    return Trigrams(rows["code"].to_numpy(dtype=np.int64), rows["n"].to_numpy(dtype=np.float64))


def canonical_values(df: DataFrame, key: str, columns: Sequence[str], changed_only: bool = False) -> DataFrame:
    """(key, field, text, changed): each non-null value of the columns in its one consistent form.

    Null values have no row; empty ones stay empty.  Repeated keys give repeated rows.
    Other columns are ignored.  Values without any suspect character can't change; they
    bypass Python.  ``changed_only`` leaves them out.
    """
    model = df.sparkSession.sparkContext.broadcast(learn(df, columns))
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("text")) for c in columns])
    values = df.select(F.col(key).alias(key), F.inline(pairs)).where(F.col("text").isNotNull())
    suspect = F.col("text").rlike(suspect_pattern())

    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo: dict[str, str] = {}
        for batch in batches:
            new = [canonical(t, model.value, memo) for t in batch["text"]]
            batch["changed"] = [a != b for a, b in zip(new, batch["text"], strict=True)]
            batch["text"] = new
            yield batch[batch["changed"]] if changed_only else batch

    kind = dict(df.dtypes)[key]
    settled = values.where(suspect).mapInPandas(settle, f"`{key}` {kind}, field string, text string, changed boolean")
    if changed_only:
        return settled
    return settled.unionByName(values.where(~suspect).withColumn("changed", F.lit(False)))
