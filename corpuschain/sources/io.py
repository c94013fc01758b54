"""Sources and sinks.

Schemas are given, never inferred, so that reading starts without a pass over the data and an
unexpected field is ignored rather than changing a type.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REPORT = (
    "book_id INT, number INT, text STRING, matn STRING, isnad STRING, matn_confidence STRING, grade STRING, chapter STRING, "
    "page INT, page_id INT, volume STRING, kind STRING, sort INT"
)
NARRATOR = (
    "name STRING, aliases ARRAY<STRING>, kunya STRING, grade STRING, death_year INT, source STRING, "
    "opinions ARRAY<STRUCT<source: STRING, grade: STRING>>, appraisals ARRAY<STRUCT<critic: STRING, verdict: STRING, book: STRING>>"
)
BOOK = (
    "book_id INT, name STRING, author_id INT, cat_id INT, page_count INT, source STRING, meta MAP<STRING, STRING>, "
    "indexes STRUCT<numbers: MAP<STRING, INT>, headings: ARRAY<STRUCT<page: INT, level: INT, title: STRING>>>, "
    "pages ARRAY<STRUCT<pg: INT, meta: STRUCT<page: INT, vol: STRING>, text: STRING>>"
)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One record a line; blank lines are skipped, damaged ones are in ``damaged_lines``."""
    return _lines(spark, path, schema).where("r._damaged IS NULL").select("r.*").drop("_damaged")


def damaged_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(file, line): the lines that are no record, for a report; none is lost without a word."""
    return _lines(spark, path, schema).where("r._damaged IS NOT NULL").select("file", F.col("r._damaged").alias("line"))


def _lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(r, file): each line that is not blank as a record, with ``_damaged`` the line itself where it is none."""
    lines = spark.read.text(path).where(F.trim("value") != "").select("value", F.col("_metadata.file_name").alias("file"))
    return lines.select(F.from_json("value", f"{schema}, _damaged STRING", {"columnNameOfCorruptRecord": "_damaged"}).alias("r"), "file")


def corpus(spark: SparkSession, folder: str, schema: str = REPORT) -> DataFrame:
    """All line-JSON files of a folder with the file each record came from, whose names give the order."""
    return _lines(spark, folder, schema).where("r._damaged IS NULL").select("r.*", "file").drop("_damaged")


def books(spark: SparkSession, path: str) -> DataFrame:
    """Whole books, one JSON document a file."""
    return spark.read.schema(BOOK).option("multiLine", "true").json(path)


def pages(books_: DataFrame) -> DataFrame:
    """(book_id, pg, page, vol, text) of every page."""
    return books_.select("book_id", F.explode("pages").alias("p")).select("book_id", "p.pg", "p.meta.page", "p.meta.vol", "p.text")


def headings(books_: DataFrame) -> DataFrame:
    """(book_id, page, level, title) of every heading of the index."""
    return books_.select("book_id", F.inline("indexes.headings"))


def page_slice(pages_: DataFrame, book_id: int, start: int, count: int) -> DataFrame:
    """The pages of a book from a place on."""
    return pages_.where((F.col("book_id") == book_id) & (F.col("pg") >= start) & (F.col("pg") < start + count))


def first_text_page(books_: DataFrame) -> DataFrame:
    """(book_id, first): the first page that the number index names."""
    return books_.select("book_id", F.array_min(F.map_values("indexes.numbers")).alias("first"))


def catalogue_books(spark: SparkSession, path: str) -> DataFrame:
    """(id, name, author_id, cat_id, has_pdf, size, page_count) from a catalogue document."""
    schema = "books MAP<STRING, STRUCT<id: INT, name: STRING, author_id: INT, cat_id: INT, has_pdf: BOOLEAN, size: INT, page_count: INT>>"
    return spark.read.schema(schema).option("multiLine", "true").json(path).select(F.explode("books").alias("k", "b")).select("b.*")


def select_books(catalogue: DataFrame, explicit: Sequence[int] = (), priority: Sequence[int] = (), categories: Sequence[int] = ()) -> DataFrame:
    """The chosen books with their ``place``: explicit ids alone if any, else priority books, then categories; each book once."""
    in_order = lambda ids: F.array_position(F.array(*[F.lit(i) for i in ids]) if ids else F.array().cast("array<int>"), F.col("id"))
    if explicit:
        return catalogue.where(F.col("id").isin(*explicit)).withColumn("place", in_order(explicit))
    first = in_order(priority)
    tier = F.when(first > 0, first).when(F.col("cat_id").isin(*categories) if categories else F.lit(False), len(priority) + 1)
    return catalogue.withColumn("place", tier.cast("bigint")).where(F.col("place").isNotNull())


def write_json(df: DataFrame, path: str, *partition: str) -> None:
    """Line JSON, one folder for each value of the partition columns."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition) if partition else writer).json(path)


def rebuild(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> int:
    """Builds a table beside the old one and swaps it in when it is whole; the number of its rows.

    A failed build leaves the old table as it was.
    """
    fresh = f"{path.rstrip('/')}.building"
    build().write.mode("overwrite").parquet(fresh)
    n = spark.read.parquet(fresh).count()
    jvm = spark.sparkContext._jvm
    target, source, old = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, fresh, f"{path.rstrip('/')}.old"))
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(old, True)
    if fs.exists(target):
        fs.rename(target, old)
    fs.rename(source, target)
    fs.delete(old, True)
    return n


def replace_partitions(spark: SparkSession, df: DataFrame, path: str, *partition: str) -> None:
    """Overwrites only the partitions that ``df`` has; others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition).parquet(path)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old rows whose key has no new row, and the new rows."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def cache_key(text: Column, model: str, dim: int) -> Column:
    """The key under which an embedding of a text is kept for a model."""
    return F.sha1(F.concat(F.lit(f"{model}:{dim}"), F.lit("\x00"), text))


def split_by_cache(df: DataFrame, cache: DataFrame, key: str, text: str, model: str, dim: int) -> tuple[DataFrame, DataFrame]:
    """(hits, misses): rows whose text the cache (h, v) has, with v, and one row for each text that it has not."""
    keyed = df.select(key, text, cache_key(F.col(text), model, dim).alias("h"))
    hits = keyed.join(cache, "h")
    misses = keyed.join(cache.select("h"), "h", "left_anti").groupBy("h").agg(F.min(text).alias(text))
    return hits, misses


def cache_counts(df: DataFrame, cache: DataFrame, text: str, model: str, dim: int) -> DataFrame:
    """(total, new, reused) of an incremental run: rows, texts to embed, rows that the cache covers."""
    known = cache.select("h").distinct().withColumn("known", F.lit(True))
    keyed = df.where(F.col(text).isNotNull()).select(cache_key(F.col(text), model, dim).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    joined = keyed.join(known, "h", "left")
    return joined.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count_if(F.col("known").isNull()).alias("new"), F.coalesce(F.sum(F.when(F.col("known"), F.col("n"))), F.lit(0)).alias("reused"))
