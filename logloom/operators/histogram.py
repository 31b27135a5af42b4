"""Time histograms with fixed, epoch-aligned intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import chart_label, col, interval_millis, iso_utc

_CHUNK = 10_000


def bucket_millis(ts: Column | str, interval: str) -> Column:
    """Start of the bucket a timestamp falls into, as epoch milliseconds."""
    step = interval_millis(interval)
    return F.floor(F.unix_millis(col(ts)) / step) * step


def bucket_counts(df: DataFrame, interval: str, ts: Column | str = "timestamp") -> DataFrame:
    """``(bucket, n)`` of the buckets that hold rows."""
    return (
        df.select(bucket_millis(ts, interval).alias("bucket"))
        .where(F.col("bucket").isNotNull())
        .groupBy("bucket")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def fill_gaps(counts: DataFrame, interval: str) -> DataFrame:
    """Add the empty buckets between the first and the last one.

    The list of buckets is unfolded in two steps, so that no array grows with
    the number of buckets. ``rows`` is carried along only to keep this branch on
    the same aggregate as the joined one, which Spark then computes once.
    """
    span = counts.agg(
        F.min("bucket").alias("lo"), F.max("bucket").alias("hi"), F.sum("n").alias("rows")
    ).where(F.col("rows") > 0)
    return every_bucket(span, interval).join(counts, "bucket", "left").select(
        "bucket", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")
    )


def every_bucket(span: DataFrame, interval: str) -> DataFrame:
    """``(bucket, position)`` from ``lo`` to ``hi`` of a one-row table, in two unfolding steps."""
    step = interval_millis(interval)
    chunk_width = step * _CHUNK
    last_chunk = F.floor((F.col("hi") - F.col("lo")) / chunk_width)
    chunks = span.select(
        "lo", "hi", F.explode(F.sequence(F.lit(0).cast("bigint"), last_chunk)).alias("chunk")
    ).select("lo", "hi", (F.col("lo") + F.col("chunk") * chunk_width).alias("start"))
    every = chunks.select(
        "lo",
        F.explode(
            F.sequence(
                F.col("start"),
                F.least(F.col("hi"), F.col("start") + F.lit(chunk_width - step)),
                F.lit(step).cast("bigint"),
            )
        ).alias("bucket"),
    )
    position = (F.col("bucket") - F.col("lo")) / step + 1
    return every.select("bucket", position.cast("bigint").alias("position"))


def date_histogram(
    df: DataFrame, interval: str = "1h", ts: Column | str = "timestamp", gaps: bool = True
) -> DataFrame:
    """``(bucket timestamp, n)``; rows without a timestamp fall into no bucket."""
    counts = bucket_counts(df, interval, ts)
    if gaps:
        counts = fill_gaps(counts, interval)
    return counts.select(F.timestamp_millis("bucket").alias("bucket"), "n")


def time_series(
    df: DataFrame, interval: str = "1h", ts: Column | str = "timestamp"
) -> DataFrame:
    """The histogram as the API returns it: ISO timestamps and counts."""
    return date_histogram(df, interval, ts).select(iso_utc("bucket").alias("timestamp"), "n")


def labelled(histogram: DataFrame) -> DataFrame:
    return histogram.select(iso_utc("bucket").alias("timestamp"), chart_label("bucket").alias("label"), "n")


def peak_and_low(histogram: DataFrame) -> DataFrame:
    """Fullest and emptiest bucket; the earlier one on ties."""
    at = F.unix_millis("bucket")
    return histogram.agg(
        F.max(F.struct(F.col("n"), (-at).alias("at"))).alias("peak"),
        F.min(F.struct(F.col("n"), at.alias("at"))).alias("low"),
    ).select(
        iso_utc(F.timestamp_millis(-F.col("peak.at"))).alias("peak_at"),
        F.col("peak.n").alias("peak_n"),
        iso_utc(F.timestamp_millis(F.col("low.at"))).alias("low_at"),
        F.col("low.n").alias("low_n"),
    )
