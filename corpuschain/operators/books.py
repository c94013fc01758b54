"""Browsing and ordering inside books: collections, chapters, pages, and what stands open where."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def collections(df: DataFrame, book: str, key: str, name: str | None = None, unit: str | None = None) -> DataFrame:
    """(book, n, first_id, name): the records of each book, or its distinct ``unit``s, with the name of the first record."""
    n = F.count_distinct(F.col(unit)) if unit else F.count(F.lit(1))
    out = [n.alias("n"), F.min(key).alias("first_id")]
    if name:
        out.append(F.min_by(name, key).alias("name"))
    return df.groupBy(book).agg(*out)


def chapters(df: DataFrame, book: str, chapter: str, number: str, sort: str, key: str) -> DataFrame:
    """(book, chapter, n, first_number, first_id): chapters with the place where they begin."""
    at = F.coalesce(F.col(number).try_cast("bigint"), F.col(sort).cast("bigint"))
    return df.groupBy(book, chapter).agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("first_number"), F.min(key).alias("first_id"))


def paged(df: DataFrame, offset: int, limit: int, *order: Column) -> DataFrame:
    """One page of an ordered list; ask for one row more to know whether another follows."""
    return df.orderBy(*order).offset(offset).limit(limit)


def inherited(df: DataFrame, book: str, order: Sequence[str], value: str, empty: Column) -> DataFrame:
    """``value`` where ``empty`` holds becomes that of the last record before it in the book whose value isn't empty."""
    before = Window.partitionBy(book).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = F.when(~empty, F.col(value))
    return df.withColumn(value, F.when(empty, F.last(own, ignorenulls=True).over(before)).otherwise(F.col(value)))


def running_max(df: DataFrame, book: str, order: Sequence[str], value: str, name: str) -> DataFrame:
    upto = Window.partitionBy(book).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.max(value).over(upto))


def ranges(df: DataFrame, book: str, start: str, name: str, last: Column | None = None) -> DataFrame:
    """``name``: where each record ends, one before the next start, and ``last`` (or null) for the final one."""
    following = F.lead(start).over(Window.partitionBy(book).orderBy(start)) - 1
    return df.withColumn(name, F.greatest(F.coalesce(following, last) if last is not None else following, F.col(start)))


def dense_start(df: DataFrame, book: str, order: str, flag: Column, run: int = 15, least: int = 12) -> DataFrame:
    """(book, first): where a book's entries begin: the first place from which ``least`` of the next ``run`` have the flag."""
    ahead = Window.partitionBy(book).orderBy(order).rowsBetween(0, run - 1)
    dense = df.select(book, order, F.sum(F.coalesce(flag, F.lit(False)).cast("int")).over(ahead).alias("n")).where(F.col("n") >= least)
    return dense.groupBy(book).agg(F.min(order).alias("first"))


def open_headings(headings: DataFrame, pages: DataFrame, book: str, page: str, level: str, title: str, levels: int = 4) -> DataFrame:
    """(book, page, path): the headings open at each page; a heading closes those as deep or deeper.

    An as-of join without a join: headings and pages are one ordered stream, and each level carries its last
    title since a shallower heading.
    """
    marks = headings.select(F.col(book).alias("b"), F.col(page).alias("p"), F.col(level).cast("int").alias("l"), F.col(title).alias("t"), F.lit(0).alias("kind"))
    asks = pages.select(F.col(book).alias("b"), F.col(page).alias("p"), F.lit(None).cast("int").alias("l"), F.lit(None).cast("string").alias("t"), F.lit(1).alias("kind")).distinct()
    upto = Window.partitionBy("b").orderBy("p", "kind", "l").rowsBetween(Window.unboundedPreceding, 0)
    stream = marks.unionByName(asks)
    parts = []
    for n in range(1, levels + 1):
        # at this level: its own title opens it, a shallower heading clears it
        own = F.when(F.col("l") == n, F.struct("t")).when(F.col("l") < n, F.struct(F.lit(None).cast("string").alias("t")))
        parts.append(F.last(own, ignorenulls=True).over(upto)["t"])
    path = F.concat_ws(" / ", *parts)
    return stream.select("b", "p", "kind", path.alias("path")).where("kind = 1").select(F.col("b").alias(book), F.col("p").alias(page), F.when(F.col("path") != "", F.col("path")).alias("path"))


def passages(chunks: DataFrame, by: Sequence[str], pos: str, text: str) -> DataFrame:
    """(by, text): the pieces of each passage in order, joined by spaces."""
    parts = F.array_sort(F.collect_list(F.struct(pos, text)))
    return chunks.groupBy(*by).agg(F.array_join(F.transform(parts, lambda p: p[text]), " ").alias("text"))


def citation_line(df: DataFrame, by: str, collection: str, number: str, order: str) -> DataFrame:
    """(by, line): the collections in the order of their first record, each with its distinct numbers."""
    per = df.groupBy(by, collection).agg(F.min(order).alias("first"), F.array_sort(F.collect_set(F.col(number).cast("bigint"))).alias("numbers"))
    entry = F.concat(F.col(collection), F.when(F.size("numbers") > 0, F.concat(F.lit(" "), F.array_join(F.transform("numbers", lambda n: n.cast("string")), ", "))).otherwise(""))
    listed = F.array_sort(F.collect_list(F.struct("first", entry.alias("entry"))))
    return per.groupBy(by).agg(F.array_join(F.transform(listed, lambda x: x["entry"]), "; ").alias("line"))


def fused_chapters(df: DataFrame, book: str, chapter: str, number: str, least: int = 15, span: int = 50) -> DataFrame:
    """Chapters that hold so many records over so wide a range of numbers that they are likely several."""
    width = F.max(number) - F.min(number)
    return df.where(F.col(chapter).isNotNull()).groupBy(book, chapter).agg(F.count(F.lit(1)).alias("n"), width.alias("span")).where((F.col("n") >= least) & (F.col("span") >= span))
