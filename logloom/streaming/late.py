"""A time histogram of a stream that also counts late records and shows empty buckets.

Each batch adds one row for every bucket it has records of: ``(batch, bucket, n,
latest)``. Which records came late follows from these rows alone: the watermark of
a batch is the latest time of all batches before it, less the allowed delay, and a
bucket that ended by then takes no more records. This is the rule of Spark's own
watermark, whose late records are dropped without a trace; here they are counted.
Nothing is held in memory between batches, and a batch that runs again replaces
its own rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.scalars import col, interval_millis
from ..operators.histogram import bucket_millis, every_bucket

_SCHEMA = "batch bigint, bucket bigint, n bigint, latest bigint"


def count_batch(
    rows: DataFrame, batch_id: int, path: str, interval: str = "1h", ts: Column | str = "timestamp"
) -> None:
    """Write the counts of one batch; records without a timestamp fall into no bucket."""
    counted = (
        rows.groupBy(bucket_millis(ts, interval).alias("bucket"))
        .agg(F.count(F.lit(1)).alias("n"), F.max(F.unix_millis(col(ts))).alias("latest"))
        .where(F.col("bucket").isNotNull())
    )
    (
        counted.withColumn("batch", F.lit(batch_id).cast("bigint"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("batch")
        .parquet(path)
    )


def count_stream(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    interval: str = "1h",
    ts: Column | str = "timestamp",
    continuous: bool = False,
) -> StreamingQuery:
    """Count a stream batch by batch; by default what is there, then stop."""

    def run(batch: DataFrame, batch_id: int) -> None:
        count_batch(batch, batch_id, path, interval, ts)

    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer if continuous else writer.trigger(availableNow=True)).start()


def histogram(spark: SparkSession, path: str, interval: str = "1h", delay: str = "10m") -> DataFrame:
    """``(bucket, n, late, closed)`` of all buckets from the first to the last, empty ones too.

    ``n`` counts the records that came in time, ``late`` those that came when
    their bucket was closed. The rows read grow with batches times buckets, not
    with records. ``interval`` is that of the counting.
    """
    step, wait = interval_millis(interval), interval_millis(delay)
    counts = spark.read.schema(_SCHEMA).parquet(path)
    # one row a batch
    before = Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, -1)
    marks = counts.groupBy("batch").agg(F.max("latest").alias("latest"))
    marks = marks.select("batch", (F.max("latest").over(before) - wait).alias("mark"))
    closed_before = F.coalesce(F.col("bucket") + step <= F.col("mark"), F.lit(False))
    found = (
        counts.join(marks, "batch")
        .withColumn("late", F.when(closed_before, F.col("n")).otherwise(0))
        .groupBy("bucket")
        .agg(F.sum(F.col("n") - F.col("late")).alias("n"), F.sum("late").alias("late"))
    )
    span = counts.agg(F.min("bucket").alias("lo"), F.max("bucket").alias("hi")).where(F.col("lo").isNotNull())
    last_mark = counts.agg(F.max("latest").alias("latest")).scalar() - wait
    return every_bucket(span, interval).join(found, "bucket", "left").select(
        F.timestamp_millis("bucket").alias("bucket"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
        F.coalesce("late", F.lit(0)).cast("bigint").alias("late"),
        (F.col("bucket") + step <= last_mark).alias("closed"),
    )
