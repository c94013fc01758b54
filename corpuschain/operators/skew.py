"""Per-key results over keys of very uneven size, by value-frequency compression.

``compress`` groups by key *and* value first.  Its map-side partial aggregation turns
the many rows of a hot key into one weighted row for each distinct value, spread over
all tasks because the value is part of the shuffle key.  Everything below works on the
weighted values: no task ever gathers the rows of one key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuschain.runtime import Scratch

N = "n_rows"


def compress(df: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """One row for each distinct (key, values) with its number of rows ``n_rows``.

    Null keys and null values form groups of their own.  Further columns are ignored, so
    that they may have any name but ``n_rows`` among key and values.  An empty table gives
    an empty table.
    """
    if N in (key, *values):
        raise ValueError(f"{N} is the name of the count; rename the column first")
    return df.groupBy(key, *values).agg(F.count(F.lit(1)).alias(N))


def heavy_keys(df: DataFrame, key: str, percent: int = 1, value: str | None = None) -> DataFrame:
    """Keys with at least ``percent`` % of all rows, with ``n_rows``; compared in whole numbers.

    Rows are counted by key and ``value`` first, so that a hot key arrives as many groups.
    Rows with a null key count towards the total, but null is no key.  An empty table has
    no heavy key.  The total is a scalar subquery over no column.
    """
    total = df.agg(F.count(F.lit(1)).alias("total")).scalar()
    counts = compress(df.where(F.col(key).isNotNull()), key, [value] if value else []).groupBy(key).agg(F.sum(N).alias(N))
    return counts.where(F.col(N) * 100 >= total * percent)


def distinct_and_mode(weighted: DataFrame, key: str, value: str) -> DataFrame:
    """For each key: rows, non-null rows, exact distinct values, and the most frequent value.

    Takes ``compress`` output (further value columns are summed out first).  Ties for the
    mode go to the smallest value.  A key that has only null values has 0 distinct values
    and a null mode.  All aggregates have a constant-size state and combine before the
    shuffle.
    """
    per_value = weighted.groupBy(key, value).agg(F.sum(N).alias(N))
    there = F.col(value).isNotNull()
    return per_value.groupBy(key).agg(
        F.sum(N).alias(N),
        F.sum(F.when(there, F.col(N)).otherwise(F.lit(0))).alias("n_values"),
        F.sum(there.cast("bigint")).alias("n_distinct"),
        F.max_by(value, F.struct(F.when(there, F.col(N)), _descending(per_value, value))).alias("mode"),
        F.max(F.when(there, F.col(N))).alias("mode_rows"),
    )


def _descending(df: DataFrame, value: str) -> Column:
    kind = dict(df.dtypes)[value]
    if kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal"):
        return -F.col(value)
    raise TypeError(f"the mode of {kind} has no order for ties here; give a number")


def percentiles(weighted: DataFrame, key: str, value: str, points: Sequence[float], parts: int | None = None) -> DataFrame:
    """Exact discrete percentiles of the weighted values of each key.

    The p-th is the smallest value whose cumulated rows reach ``ceil(p * rows)`` (at least
    one row); null values don't count and a key with nothing else has no row.  Output:
    key, ``n_values``, and ``p<percent>`` for each point.

    The (key, value) rows are range-partitioned and written, so that a hot key is spread
    over many files; each file cumulates on its own, starting from the rows of the same key
    in the files before it.  Those totals are one row for each key and file that meet.
    """
    spark = weighted.sparkSession
    scratch = Scratch(spark, "percentiles")
    per_value = (
        weighted.where(F.col(value).isNotNull()).groupBy(F.col(key).alias("k"), F.col(value).alias("v")).agg(F.sum(N).alias("n"))
    )
    ranged = per_value.repartitionByRange(parts, "k", "v") if parts else per_value.repartitionByRange("k", "v")
    placed = scratch.cut(ranged.withColumn("part", F.spark_partition_id()), "ranged")
    totals = placed.groupBy("k", "part").agg(F.sum("n").alias("n_part"))
    along = Window.partitionBy("k").orderBy("part")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        F.col("k").alias("k_"), F.col("part").alias("part_"),
        F.coalesce(F.sum("n_part").over(before), F.lit(0)).alias("before"),
        F.sum("n_part").over(Window.partitionBy("k")).alias("n_values"),
    )
    inside = Window.partitionBy("k", "part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    run = placed.withColumn("upto", F.sum("n").over(inside)).join(starts, F.col("k").eqNullSafe(F.col("k_")) & (F.col("part") == F.col("part_"))).select(
        "k", "v", "n", "n_values", (F.col("before") + F.col("upto")).alias("upto")
    )
    def reached(p: float) -> Column:
        need = F.greatest(F.lit(1), F.ceil(F.lit(p) * F.col("n_values")))
        return F.min(F.when(F.col("upto") >= need, F.col("v")))

    return run.groupBy(F.col("k").alias(key)).agg(
        F.max("n_values").alias("n_values"), *[reached(p).alias(f"p{round(p * 100)}") for p in points]
    )
