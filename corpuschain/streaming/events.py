"""Windows over an event stream, and an incremental build by micro-batches.

The same functions take a static table, which is how their results are checked.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


def read_stream(spark: SparkSession, folder: str, schema: str = EVENTS, pattern: str = "*.parquet", files: int = 16) -> DataFrame:
    """Parquet files as they arrive in a folder, a bounded number at a time."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files).parquet(folder)


def tumbling(events: DataFrame, every: str = "1 day", late: str | None = None) -> DataFrame:
    """(start, event_type, n, total) for each window and type; on a stream rows later than ``late`` are left out."""
    rows = events.withWatermark("ts", late) if late else events
    return rows.groupBy(F.window("ts", every).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def sessions(events: DataFrame, gap: str = "6 hours", late: str | None = None) -> DataFrame:
    """(user_id, start, n): runs of a user's events with no pause of ``gap`` or more."""
    rows = events.withWatermark("ts", late) if late else events
    return rows.groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("s.start").alias("start"), "n")


def first_seen(events: DataFrame, key: str = "event_id", late: str = "1 day") -> DataFrame:
    """Each event once, though it be delivered again within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])


def upsert_batches(stream: DataFrame, path: str, checkpoint: str, key: str, prepare: Callable[[DataFrame], DataFrame] = lambda d: d):
    """A query that appends the rows of each micro-batch whose key the table lacks; a batch that is run again adds nothing."""

    def write(batch: DataFrame, _number: int) -> None:
        spark = batch.sparkSession
        rows = prepare(batch.dropDuplicates([key]))
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
            rows = rows.join(spark.read.parquet(path).select(key), key, "left_anti")
        rows.write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
