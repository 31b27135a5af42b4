"""The batch ledger and what is read from it.

A ledger has one row per batch: ``(batch_id, rows, inserted, failed,
duration_ms)``. It is small, so windows over all of it are harmless.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def batch_of(seq: Column, batch_size: int) -> Column:
    """The batch a record falls into, from its number in the input."""
    return F.floor(seq / batch_size)


def ledger(records: DataFrame, batch: Column, failed: Column, duration_ms: Column) -> DataFrame:
    """The ledger of records that carry their batch and whether they failed."""
    return records.groupBy(batch.cast("bigint").alias("batch_id")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(~failed).alias("inserted"),
        F.count_if(failed).alias("failed"),
        duration_ms.cast("bigint").alias("duration_ms"),
    )


def progress(batches: DataFrame, expected_total: int) -> DataFrame:
    """After each batch: rows so far, percent, rate per second, seconds to go."""
    so_far = W.orderBy("batch_id").rowsBetween(W.unboundedPreceding, 0)
    total = F.sum("inserted").over(so_far)
    elapsed = F.sum("duration_ms").over(so_far) / 1000.0
    out = batches.select(
        "batch_id", "inserted", total.alias("total"), elapsed.alias("elapsed")
    )
    rate = F.try_divide(F.col("total"), F.col("elapsed"))
    remaining = F.lit(expected_total) - F.col("total")
    return out.select(
        "batch_id",
        "inserted",
        "total",
        F.round(F.col("total").cast("decimal(20,0)") * 100 / expected_total, 2)
        .cast("double")
        .alias("percent"),
        F.floor(rate + 0.5).alias("rate"),
        F.floor(F.try_divide(remaining.cast("double"), rate) + 0.5).alias("eta"),
    )


def summary(batches: DataFrame, requested: int | None = None) -> DataFrame:
    """Totals of a run. The average rate counts requested rows; the rate of rows
    really inserted stands beside it."""
    n = F.count(F.lit(1))
    inserted = F.coalesce(F.sum("inserted"), F.lit(0))
    duration = F.coalesce(F.sum("duration_ms"), F.lit(0))
    asked = F.coalesce(F.sum("rows"), F.lit(0)) if requested is None else F.lit(requested)

    def mean(x: Column) -> Column:
        return F.coalesce(F.try_divide(x.cast("double"), n), F.lit(0.0))

    return batches.agg(
        n.alias("batches"),
        inserted.alias("total_inserted"),
        F.coalesce(F.sum("failed"), F.lit(0)).alias("failed_documents"),
        mean(inserted).alias("average_batch_size"),
        duration.alias("total_duration_ms"),
        mean(duration).alias("average_batch_duration_ms"),
        F.coalesce(F.max("duration_ms"), F.lit(0)).alias("max_batch_duration_ms"),
        F.try_divide(asked * 1000.0, duration).alias("average_rate_per_second"),
        F.try_divide(inserted * 1000.0, duration).alias("inserted_rate_per_second"),
    )
