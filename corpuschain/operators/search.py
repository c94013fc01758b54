"""Lexical retrieval: weighted BM25 over a table (``index`` has the stored one), filters and facets.

Scores are one aggregation over the postings of the query's terms only: those are filtered
before any shuffle, and the statistics of a term (how many records have it) come from the
same postings.  Ranking is ``orderBy().limit()``, which keeps only k rows a task.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuschain.functions import text as T

K1, B = 1.2, 0.75
#: Weights of a report's columns.
WEIGHTS = {"matn": 10.0, "chapter": 4.0, "isnad": 1.0}
#: What a term that more than half of all records have still counts.
FLOOR = 1e-6


def term_frequencies(words_by_id: DataFrame, key: str, words: Column) -> DataFrame:
    """(term, df): how many records have each term."""
    return words_by_id.select(F.explode(F.array_distinct(words)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def bm25(df: DataFrame, key: str, columns: Mapping[str, Column], terms: Sequence[str], weights: Mapping[str, float] | None = None, match: str = "auto", fields: Sequence[str] | None = None) -> DataFrame:
    """(id, score, n_terms) of each record that matches, by weighted BM25 with one length for all columns.

    ``match``: ``or`` any term, ``and`` every term, ``auto`` every term or, where no record has
    all, any.  ``fields`` restricts matching to some columns.  Statistics are those of the whole
    table.  A query without terms matches nothing.  Records with a null or empty text have
    no postings but count in the statistics.
    """
    terms = list(dict.fromkeys(terms))
    weights = weights or dict.fromkeys(columns, 1.0)
    # each column's words are computed once a row; only the query's terms are exploded
    split = df.select(F.col(key).alias("id"), *[words.alias(f"w_{f}") for f, words in columns.items()])
    sizes = [F.coalesce(F.size(f"w_{f}"), F.lit(0)) for f in columns]
    length = sum(sizes[1:], sizes[0]).cast("bigint")
    n, mean = split.agg(F.count(F.lit(1))).scalar(), split.agg(F.avg(length)).scalar()
    hits_of = [
        F.struct(F.lit(float(weights.get(f, 1.0))).alias("w"), F.coalesce(F.filter(f"w_{f}", lambda t: t.isin(*terms)), F.array().cast("array<string>")).alias("terms"))
        for f in columns
        if not fields or f in fields
    ]
    found = split.select("id", length.alias("length"), F.inline(F.array(*hits_of))).select("id", "length", "w", F.explode("terms").alias("term"))
    per_term = found.groupBy("id", "term").agg(F.sum("w").alias("f"), F.first("length").alias("length"))
    return scored(per_term, n, mean, terms, match)


def scored(per_term: DataFrame, n: Column, mean: Column, terms: Sequence[str], match: str) -> DataFrame:
    """(id, score, n_terms) from (id, term, f, length) of the query's terms, the number of records and their mean length."""
    spread = per_term.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    rated = spread.select("term", F.when(idf > 0, idf).otherwise(FLOOR).alias("idf"))
    rated_terms = per_term.join(F.broadcast(rated), "term")  # as many rows as the query has terms
    gain = F.col("idf") * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("length") / mean))
    hits = rated_terms.groupBy("id").agg(F.round(F.sum(gain), 9).alias("score"), F.count(F.lit(1)).alias("n_terms"))
    if match == "and":
        return hits.where(F.col("n_terms") == len(terms))
    if match == "auto":
        full = hits.agg(F.max(F.col("n_terms"))).scalar()
        return hits.where((F.col("n_terms") == len(terms)) | (full < len(terms)))
    if match != "or":
        raise ValueError("match is and, or, or auto")
    return hits


def top(hits: DataFrame, k: int, *order: Column) -> DataFrame:
    """The k first; the last key should be unique."""
    return hits.orderBy(*order).limit(k)


def report_words(fields: Sequence[str] = ("matn", "chapter", "isnad")) -> dict[str, Column]:
    return {f: T.words(T.normalize(F.col(f))) for f in fields}


def facet_counts(hits: DataFrame, *facets: str) -> DataFrame:
    """(facet, value, n): the non-null values of each facet among the hits, in one pass."""
    listed = F.array(*[F.struct(F.lit(f).alias("facet"), F.col(f).cast("string").alias("value")) for f in facets])
    return hits.select(F.inline(listed)).where(F.col("value").isNotNull()).groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n"))


def multi_select_facets(df: DataFrame, filters: Mapping[str, Column], *facets: str) -> DataFrame:
    """(facet, value, n): each facet counted under the filters of the *other* facets, in one pass over the rows."""
    listed = []
    for f in facets:
        others = F.lit(True)
        for name, condition in filters.items():
            if name != f:
                others = others & F.coalesce(condition, F.lit(False))
        listed.append(F.struct(F.lit(f).alias("facet"), F.when(others, F.col(f).cast("string")).alias("value")))
    return df.select(F.inline(F.array(*listed))).where(F.col("value").isNotNull()).groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n"))


def reciprocal_rank_fusion(*rankings: DataFrame, k: int = 60) -> DataFrame:
    """(id, score): the sum of ``1 / (k + rank)`` over rankings (id, rank), whose ranks start at 1."""
    every = rankings[0].select("id", "rank")
    for r in rankings[1:]:
        every = every.unionByName(r.select("id", "rank"))
    return every.groupBy("id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"))


def ranked(hits: DataFrame, k: int, *order: Column) -> DataFrame:
    """(…, rank) of the k first; the window runs over those k rows only."""
    return top(hits, k, *order).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def md5_bucket(word: Column, dim: int) -> Column:
    """The md5 of a word modulo ``dim``, which must be a power of 2 up to 2^28."""
    if dim & (dim - 1) or not 0 < dim <= 1 << 28:
        raise ValueError("dim must be a power of two")
    digits = max(1, -(-int(math.log2(dim)) // 4))
    return F.conv(F.substring(F.md5(word.cast("binary")), -digits, digits), 16, 10).cast("int") % dim


def hash_embedding(words: Column, dim: int = 256) -> Column:
    """Counts of md5 buckets, divided by their length; all zero without words.  ``dim`` must be a power of 2 up to 2^28."""
    buckets = F.transform(words, lambda w: md5_bucket(w, dim))

    # one-element arrays bind a value, so that it is computed once and not for every bucket
    def count(own: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: (F.size(own) - F.size(F.array_remove(own, i))).cast("double"))

    def scaled(counted: Column) -> Column:
        norm = F.sqrt(F.aggregate(counted, F.lit(0.0), lambda a, x: a + x * x))
        return F.transform(F.array(norm), lambda n: F.transform(counted, lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0))))[0]

    return F.transform(F.transform(F.array(buckets), count), scaled)[0]


def hash_buckets(df: DataFrame, key: str, words: Column, dim: int = 256) -> DataFrame:
    """(key, bucket, x): the non-zero entries of ``hash_embedding``, counted by aggregation and not by a scan for each bucket."""
    spelt = df.select(key, F.explode(words).alias("word"))
    counted = spelt.select(key, md5_bucket(F.col("word"), dim).alias("bucket")).groupBy(key, "bucket").agg(F.count(F.lit(1)).cast("double").alias("n"))
    norm = F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy(key)))
    return counted.select(key, "bucket", (F.col("n") / norm).alias("x"))


def cosine(a: Column, b: Column) -> Column:
    """Dot product; of unit vectors, their cosine."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def vector_top(vectors: DataFrame, key: str, vector: str, query: Sequence[float], k: int) -> DataFrame:
    """(id, score) of the k vectors with the highest cosine to one query vector; vectors of another dimension don't count."""
    wanted = F.array(*[F.lit(float(x)) for x in query])
    hits = vectors.where(F.size(vector) == len(query)).select(F.col(key).alias("id"), F.round(cosine(F.col(vector), wanted), 6).alias("score"))
    return top(hits, k, F.desc("score"), F.asc("id"))
