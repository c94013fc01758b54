"""Texts cut off by field limits or in transfer.

One pass over the texts runs a stack automaton over each value: quotes, brackets, markup
tags, character entities, escapes and broken multibyte sequences that are open where the
value ends.  The same pass counts words, so that the ends can be judged against the
corpus:

* *limit*: the lengths of a source pile up at its greatest length, in characters or in
  UTF-8 bytes; a value of that length without the terminator that the source is wont to
  write was cut by the field.
* *open*: the automaton ends inside a construct, or on a mark that loaders leave at a cut.
* *word*: the value ends in a fragment, which begins other words ``FRAGMENT`` times as often as it is
  a word of its own elsewhere, at any size of the corpus.
* *sentence*: the value ends on a word, or right after one, that practically never ends a
  sentence (in the chain field: a value) anywhere else.
* *end*: the value has no terminator in a source that practically never leaves it out.

All of these are rates, smoothed by what no evidence amounts to (``NEVER``, ``UNSEEN``), so that the
rules are the same at every size.  Gaps that an author marked inside a text don't count, nor a
missing full stop alone in a source that is not strict about them.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuschain.llm.visual import plain_form
from corpuschain.runtime import Scratch

# What loaders append to a cut text.
CUT_MARKS = ("[...]", "[…]", "(...)", "...", "…")
TERMINATORS = ".!?؟۔。»”\""
#: How many times as often a fragment begins longer words as it stands alone; one never seen alone counts as seen so often.
FRAGMENT, UNSEEN = 50, 0.06
#: A rate that is practically never, once one more case is added to those seen.
NEVER = 1 / 200
_SENTENCE_ENDS = ".!?؟۔"
_PAIRS = {"«": "»", "(": ")", "[": "]", "{": "}", "“": "”", "‹": "›"}
_CLOSERS = {v: k for k, v in _PAIRS.items()}
_SPECIAL = re.compile(r"[«»()\[\]{}“”‹›\"]|<!--|-->|<[^<>]*>")
_TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9]*)[^<>]*?(/?)>")
# Elements of HTML without an end tag, and those whose end tag may be left out.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
OPTIONAL = ("p", "li", "dt", "dd", "tr", "td", "th", "thead", "tbody", "tfoot", "option", "colgroup", "html", "head", "body")
#: Markup, entity or escape that the end of the value interrupts.
_BROKEN_END = re.compile(r"<(?:/?[A-Za-z][^<>]*|/|!-?-?[^<>]*)?\Z|&(?:#(?:\d*|[xX][0-9a-fA-F]*)|[A-Za-z][A-Za-z0-9]{0,30})?\Z|\\(?:u[0-9a-fA-F]{0,3}|x[0-9a-fA-F]?)?\Z|%(?:[0-9A-Fa-f])?\Z")
_MARKS = {c: None for c in [*range(0x610, 0x61B), 0x640, *range(0x64B, 0x660), 0x670, *range(0x6D6, 0x6EE)]}
_TOKENS = re.compile(r"[^\W_]+|[.!?؟۔]")
_REMARK = re.compile(r"<[^<>]*>|\[[^\[\]]*\]|\([^()]*\)")

FEATURES = "id bigint, source string, field string, n_chars int, n_bytes int, ended boolean, open boolean, last string, prev string, word string, n_safe bigint, n_end bigint, n_next_end bigint, source_null boolean"


def automaton(text: str) -> bool:
    """True where a quote, bracket, comment or tag is open at the end.

    A closing sign without its opening one is ignored, as is one of another kind that stands
    deeper: it closes back to its partner.  A straight quote closes the open one, if there is one,
    and else opens where a word begins.  Signs inside a tag are the tag's own; void elements and those whose end tag may be left out don't stay open.
    """
    stack: list[str] = []

    def close(sign: str) -> bool:
        if sign not in stack:
            return False
        while stack.pop() != sign:
            pass
        return True

    for match in _SPECIAL.finditer(text):
        sign = match.group()
        if "<!--" in stack and sign != "-->":
            continue
        if sign in _PAIRS or sign == "<!--":
            stack.append(sign)
        elif sign in _CLOSERS:
            close(_CLOSERS[sign])
        elif sign == "-->":
            close("<!--")
        elif sign == '"':
            before, after = text[match.start() - 1 : match.start()], text[match.end() : match.end() + 1]
            if not close('"') and not (before and before.isalnum()) and after and not after.isspace():
                stack.append('"')
        elif tag := _TAG.fullmatch(sign):
            name = tag.group(2).lower()
            if tag.group(1):
                close(f"<{name}")
            elif not tag.group(3) and name not in VOID and name not in OPTIONAL:
                stack.append(f"<{name}")
    return bool(stack)


def ending(text: str) -> tuple[str, bool, bool]:
    """The value without what a loader appended, whether something is broken off at its end, and whether it ends in a terminator."""
    core, broken = text.rstrip(), False
    if core.endswith("�"):
        return core.rstrip("�"), True, False
    for mark in CUT_MARKS:
        if core.endswith(mark):
            core, broken = core[: -len(mark)].rstrip(), True
            return core, broken, False
    if _BROKEN_END.search(core):
        return _BROKEN_END.sub("", core), True, False
    return core, False, core[-1:] in TERMINATORS


def features(columns: Sequence[str]):
    """For ``mapInPandas``: one row for each value, then rows of word counts for each batch of rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out, counts = [], {f: (Counter(), Counter(), Counter()) for f in columns}
            for field in columns:
                safe, end, next_end = counts[field]
                for key, source, text in zip(batch["id"], batch["source"], batch[field], strict=True):
                    if text is None or not text.strip():
                        continue
                    text = plain_form(text)
                    core, broken, ended = ending(text)
                    byte_broken = text.rstrip().endswith("�")
                    tokens = _TOKENS.findall(_REMARK.sub(" ", core).translate(_MARKS))
                    words = [t for t in tokens if t not in _SENTENCE_ENDS]
                    last, prev = (words[-1] if words else None), (words[-2] if len(words) > 1 else None)
                    closed = bool(tokens) and tokens[-1] in _SENTENCE_ENDS
                    safe.update(words if closed else words[:-1])
                    for a, b, c in zip(["", *tokens], tokens, tokens[1:]):
                        if c in _SENTENCE_ENDS and b not in _SENTENCE_ENDS:
                            end[b] += 1
                            if a and a not in _SENTENCE_ENDS:
                                next_end[a] += 1
                    out.append((key, source, field, len(core), len(core.encode("utf-8", "surrogatepass")) + byte_broken, ended, broken or automaton(core), last, prev, None, None, None, None, source is None))
            for field, (safe, end, next_end) in counts.items():
                out.extend((None, None, field, None, None, None, None, None, None, w, n, end[w], next_end[w], None) for w, n in safe.items())
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in FEATURES.split(", ")], dtype=object)
            yield frame

    return run


def limits(values: DataFrame) -> DataFrame:
    """(source, field, unit, top): the sources whose lengths pile up at their greatest, from (source, field, length) counts.

    A pile is 1 % of the source within two units of the greatest length, eight times what the thirty
    lengths below hold on average (with five values more, so that a few long texts are no pile), with at
    most one value in 200 (but not none at all only) above it.
    """
    lengths = F.array(F.struct(F.lit("chars").alias("unit"), F.col("n_chars").alias("length")), F.struct(F.lit("bytes").alias("unit"), F.col("n_bytes").alias("length")))
    counts = values.select("source", "field", F.inline(lengths)).groupBy("source", "field", "unit", "length").agg(F.count(F.lit(1)).alias("n"))
    group = Window.partitionBy("source", "field", "unit")
    along = group.orderBy("length")
    seen = counts.select(
        "*",
        F.sum("n").over(group).alias("total"),
        F.sum("n").over(along.rangeBetween(1, Window.unboundedFollowing)).alias("above"),
        F.sum("n").over(along.rangeBetween(-2, 0)).alias("pile"),
        F.sum("n").over(along.rangeBetween(-32, -3)).alias("below"),
    )
    piles = seen.where(
        (F.coalesce("above", F.lit(0)) * 200 <= F.col("total"))
        & (F.col("pile") * 100 >= F.col("total"))
        & (F.col("pile") * 30 >= 8 * 3 * (F.coalesce("below", F.lit(0)) + 5))
    )
    best = piles.groupBy("source", "field", "unit").agg(F.max_by("length", F.struct("n", "length")).alias("top"), F.max("pile").alias("pile"), F.max("n").alias("peak"))
    return best.groupBy("source", "field").agg(F.max_by(F.struct("unit", "top"), F.struct("peak", "pile", "unit")).alias("limit"))


def judge(df: DataFrame, key: str, source: str, columns: Sequence[str], value_ends: Sequence[str] = ()) -> DataFrame:
    """(key, field, source, reason): each non-blank value, with the reason why it counts as cut, or null.

    ``value_ends`` names the columns whose values end where their sentence ends, such as
    chains; there the ends of values, not of sentences, tell which words may stand last.
    Null and blank values have no row; values with a null source are judged, with the rates
    of a source of their own.  Other columns are ignored.  An empty table gives no rows.
    """
    scratch = Scratch(df.sparkSession, "truncation")
    kind = dict(df.dtypes)[source]
    narrow = df.select(F.col(key).cast("bigint").alias("id"), F.col(source).cast("string").alias("source"), *[F.col(c).cast("string").alias(c) for c in columns])
    seen = scratch.cut(narrow.mapInPandas(features(columns), FEATURES), "features")
    values = seen.where("field IS NOT NULL AND word IS NULL").drop("word", "n_safe", "n_end", "n_next_end", "source_null")
    words = seen.where("word IS NOT NULL").groupBy("field", "word").agg(F.sum("n_safe").alias("n_safe"), F.sum("n_end").alias("n_end"), F.sum("n_next_end").alias("n_next_end"))

    source_limits = limits(values).select(F.col("source").alias("s_"), F.col("field").alias("f_"), F.col("limit.unit").alias("unit"), F.col("limit.top").alias("top"))
    habit = values.groupBy(F.col("source").alias("h_"), F.col("field").alias("hf_")).agg(F.avg(F.when(~F.col("open"), F.col("ended").cast("double"))).alias("p_ended"))
    by_source = habit.join(source_limits, F.col("h_").eqNullSafe(F.col("s_")) & (F.col("hf_") == F.col("f_")), "left")
    known = values.join(by_source, F.col("source").eqNullSafe(F.col("h_")) & (F.col("field") == F.col("hf_")))
    length = F.when(F.col("unit") == "chars", F.col("n_chars")).otherwise(F.col("n_bytes"))
    at_limit = F.coalesce(length.between(F.col("top") - F.when(F.col("unit") == "chars", 1).otherwise(2), F.col("top")), F.lit(False)) & ~(F.col("ended") & (F.col("p_ended") >= 0.2))
    known = scratch.cut(known.select("id", "source", "field", "ended", "open", "last", "prev", at_limit.alias("at_limit")), "known")
    # How often a source leaves out the terminator of a value that has no other sign of a cut.
    plain = known.where(~F.col("at_limit") & ~F.col("open")).groupBy("source", "field").agg(F.sum((~F.col("ended")).cast("bigint")).alias("left_out"), F.count(F.lit(1)).alias("n"))
    strict = plain.where(F.col("left_out") + 1 <= NEVER * F.col("n")).select(F.col("source").alias("s_"), F.col("field").alias("f_"), F.lit(True).alias("strict"))

    complete = known.where(~F.col("at_limit") & ~F.col("open"))
    ends_here = F.col("field").isin(*value_ends) if value_ends else F.lit(False)
    lasts = complete.where(ends_here).groupBy("field", F.col("last").alias("word")).agg(F.count(F.lit(1)).alias("v_end"))
    prevs = complete.where(ends_here).groupBy("field", F.col("prev").alias("word")).agg(F.count(F.lit(1)).alias("v_next"))
    counted = words.join(lasts, ["field", "word"], "left").join(prevs, ["field", "word"], "left").select(
        "field", "word", "n_safe",
        F.when(ends_here, F.coalesce("v_end", F.lit(0))).otherwise(F.col("n_end")).alias("ends"),
        F.when(ends_here, F.coalesce("v_next", F.lit(0))).otherwise(F.col("n_next_end")).alias("next_ends"),
        F.when(ends_here, F.col("n_safe") + F.coalesce("v_end", F.lit(0))).otherwise(F.col("n_safe")).alias("n_all"),
    )
    # In fields whose values end where they end, a word that is built like those that end values is no sign of a cut.
    shape = F.concat(F.substring("word", 1, 2), F.lit("_"), F.substring("word", -1, 1))
    shapes = counted.where(ends_here).groupBy("field", shape.alias("shape")).agg((F.sum("ends") * 20 >= F.sum("n_all")).alias("ender"))
    enders = counted.where(ends_here).withColumn("shape", shape).join(shapes.where("ender"), ["field", "shape"]).select("field", F.col("word").alias("last"), F.lit(True).alias("ender"))
    never_last = counted.where(F.col("ends") + 1 <= NEVER * F.col("n_all")).select("field", F.col("word").alias("last"), F.lit(True).alias("no_last"))
    never_prev = counted.where(F.col("next_ends") + 1 <= NEVER * F.col("n_safe")).select("field", F.col("word").alias("prev"), F.lit(True).alias("no_prev"))

    # Fragments: last words that the corpus has far less often on their own than as beginnings of other words.
    open_ends = known.where(~F.col("ended") & F.col("last").isNotNull()).select("field", "last").distinct()
    own = words.select("field", F.col("word").alias("last"), F.col("n_safe").alias("n_own"))
    ends = open_ends.join(own, ["field", "last"], "left").select("field", "last", F.coalesce("n_own", F.lit(0)).alias("n_own"))
    begins = words.where(F.length("word") > 1).select("field", F.col("n_safe").alias("n"), F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring(F.col("word"), F.lit(1), i))).alias("last"))
    longer = ends.join(begins, ["field", "last"]).groupBy("field", "last", "n_own").agg(F.sum("n").alias("n_longer"))
    fragments = longer.where((F.col("n_own") + UNSEEN) * FRAGMENT <= F.col("n_longer")).select("field", "last", F.lit(True).alias("fragment"))

    judged = known.join(fragments, ["field", "last"], "left").join(never_last, ["field", "last"], "left").join(never_prev, ["field", "prev"], "left").join(enders, ["field", "last"], "left")
    judged = judged.join(strict, F.col("source").eqNullSafe(F.col("s_")) & (F.col("field") == F.col("f_")), "left")
    reason = (
        F.when(F.col("at_limit"), "limit")
        .when(F.col("open"), "open")
        .when(~F.col("ended") & F.col("fragment"), "word")
        .when(~F.col("ended") & (F.col("no_last") | (F.col("no_prev") & F.col("ender").isNull())), "sentence")
        .when(~F.col("ended") & F.col("strict"), "end")
    )
    return judged.select(F.col("id").alias(key), "field", F.col("source").cast(kind).alias(source), reason.alias("reason"))


def rates(judged: DataFrame, source: str) -> DataFrame:
    """Values, cut values and their share for each source and field, and the counts of each reason."""
    return judged.groupBy(source, "field").agg(
        F.count(F.lit(1)).alias("n_values"),
        F.count("reason").alias("n_cut"),
        F.round(F.count("reason") / F.count(F.lit(1)), 6).alias("share_cut"),
        *[F.sum((F.col("reason") == r).cast("bigint")).alias(f"n_{r}") for r in ("limit", "open", "word", "sentence", "end")],
    )
