"""A stored inverted index: postings by term, one row for each record, and the statistics of the table.

Postings are written in folders by a hash of the term and sorted by term inside, so that a search reads the
folders of its terms only, and in them the row groups that hold them.  Each posting carries the length of its
record, so that scores need no other table; what filters and facets look at stands in ``records``.
"""

from __future__ import annotations

import zlib
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuschain.operators import search
from corpuschain.runtime import Scratch


class Index:
    """``postings`` (bucket, term, id, field, tf, length), ``records`` (id and the attributes) and ``statistics`` (one row: n, mean)."""

    def __init__(self, spark: SparkSession, path: str, buckets: int):
        self.path, self.buckets = path, buckets
        # an empty table leaves no file to tell the schema
        id_type = dict(spark.read.parquet(f"{path}/records").dtypes)["id"]
        self.postings = spark.read.schema(f"id {id_type}, field string, term string, tf bigint, length bigint, bucket int").parquet(f"{path}/postings")
        self.records = spark.read.parquet(f"{path}/records")
        self.statistics = spark.read.parquet(f"{path}/statistics")

    def of(self, terms: Sequence[str]) -> DataFrame:
        """The postings of some terms, by folders first."""
        folders = sorted({zlib.crc32(t.encode()) % self.buckets for t in terms})
        return self.postings.where(F.col("bucket").isin(folders) & F.col("term").isin(*terms))

    def search(self, terms: Sequence[str], weights: Mapping[str, float], match: str = "auto", fields: Sequence[str] | None = None) -> DataFrame:
        """(id, score, n_terms) of each record that matches, as ``search.bm25`` gives it, from the postings of the terms alone."""
        terms = list(dict.fromkeys(terms))
        hits = self.of(terms)
        hits = hits.where(F.col("field").isin(*fields)) if fields else hits
        weight = F.lit(1.0)
        for field, w in weights.items():
            weight = F.when(F.col("field") == field, float(w)).otherwise(weight)
        per_term = hits.groupBy("id", "term").agg(F.sum(weight * F.col("tf")).alias("f"), F.first("length").alias("length"))
        return search.scored(per_term, self.statistics.select("n").scalar(), self.statistics.select("mean").scalar(), terms, match)


def build(df: DataFrame, key: str, columns: Mapping[str, Column], path: str, attributes: Mapping[str, Column] | None = None, buckets: int = 64, salts: int = 4) -> Index:
    """Writes the index of a table to ``path``.  ``columns``: the words of each column; ``attributes``: further columns of ``records``.

    A term that all records have is counted before the shuffle and spread over ``salts`` tasks where its folder is
    written.  Records without words have no postings but count in the statistics.  An empty table gives an empty index.
    """
    sizes = [F.coalesce(F.size(w), F.lit(0)) for w in columns.values()]
    length = sum(sizes[1:], sizes[0]).cast("bigint")
    listed = F.array(*[F.struct(F.lit(name).alias("field"), F.coalesce(words, F.array().cast("array<string>")).alias("words")) for name, words in columns.items()])
    rows = df.select(F.col(key).alias("id"), length.alias("length"), F.inline(listed)).select("id", "length", "field", F.explode("words").alias("term"))
    counted = rows.groupBy("id", "field", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("length").alias("length"))
    bucket = F.pmod(F.crc32(F.col("term").cast("binary")), F.lit(buckets)).cast("int")
    placed = counted.withColumn("bucket", bucket).repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(salts))).sortWithinPartitions("bucket", "term", "id")
    placed.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    known = {name: value.alias(name) for name, value in (attributes or {}).items()}
    df.select(F.col(key).alias("id"), *known.values()).write.mode("overwrite").parquet(f"{path}/records")
    df.select(length.alias("length")).agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean")).write.mode("overwrite").parquet(f"{path}/statistics")
    return Index(df.sparkSession, path, buckets)


_kept: dict[tuple[str, str, str], Index] = {}


def kept(name: str, place: str, df: DataFrame, *args, **kwargs) -> Index:
    """The index of a table, built once for each application."""
    spark = df.sparkSession
    at = (spark.sparkContext.applicationId, name, place)
    if at not in _kept:
        _kept[at] = build(df, *args, path=Scratch(spark, f"index-{name}").root, **kwargs)
    return _kept[at]
