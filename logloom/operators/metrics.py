"""Metrics of ingested records, in a form that can be merged.

A partial is a long table ``(dimension, key, n, lo, hi, total)``. Partials of any
number of batches merge by one more aggregation, and the response times are kept
as a frequency table, so the 95th percentile stays exact without a list of values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import predicates
from ..functions.scalars import round2
from ..schema import CATEGORIES, ENVIRONMENTS, LEVELS
from .aggregates import domain, value_at_share

_NUMBERS = {
    "response_time": "metrics.response_time_ms",
    "cpu_usage": "metrics.cpu_usage",
    "memory_mb": "metrics.memory_mb",
}
_VALUES = "response_time_value"


def partials(logs: DataFrame) -> DataFrame:
    """Everything the snapshot needs, from one scan and one aggregation."""
    nothing = F.lit(None).cast("double")

    def row(dimension: str, key: Column, number: Column = nothing) -> Column:
        return F.struct(
            F.lit(dimension).alias("dimension"),
            key.cast("string").alias("key"),
            number.cast("double").alias("number"),
        )

    single = F.array(
        row("total", F.lit("")),
        row("level", F.col("level")),
        row("service", F.col("service.name")),
        row("environment", F.col("service.environment")),
        row("category", F.col("category")),
        row("errors", F.when(predicates.error_object(), F.lit(""))),
        row("geo", F.concat(F.col("geo.country"), F.lit("|"), F.col("geo.city"))),
        row(_VALUES, F.col("metrics.response_time_ms")),
        *[row(name, F.when(F.col(p).isNotNull(), F.lit("")), F.col(p)) for name, p in _NUMBERS.items()],
    )
    tags = F.transform(
        F.coalesce("tags", F.array().cast("array<string>")), lambda t: row("tag", t)
    )
    return (
        logs.select(F.inline(F.concat(single, tags)))
        .where(F.col("key").isNotNull())
        .groupBy("dimension", "key")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("number").alias("lo"),
            F.max("number").alias("hi"),
            F.sum("number").alias("total"),
        )
    )


def merge(parts: DataFrame) -> DataFrame:
    return parts.groupBy("dimension", "key").agg(
        F.sum("n").alias("n"),
        F.min("lo").alias("lo"),
        F.max("hi").alias("hi"),
        F.sum("total").alias("total"),
    )


def counts(merged: DataFrame) -> DataFrame:
    """``(dimension, key, n)``: fixed lists filled with zeros, open ones as found.

    A value outside a fixed list is counted under ``other``.
    """
    fixed = {"level": LEVELS, "environment": ENVIRONMENTS, "category": CATEGORIES}
    known = F.lit(True)
    for name, values in fixed.items():
        known = F.when(F.col("dimension") == name, F.col("key").isin(values)).otherwise(known)
    listed = ["total", "level", "service", "environment", "category", "errors", "geo", "tag"]
    found = merged.where(F.col("dimension").isin(listed)).select(
        "dimension", F.when(known, F.col("key")).otherwise("other").alias("key"), "n"
    )
    zeros = [("total", ""), ("errors", "")] + [(d, v) for d, vs in fixed.items() for v in vs]
    empty = domain(merged.sparkSession, ["x"]).select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(d).alias("dimension"),
                        F.lit(v).alias("key"),
                        F.lit(0).cast("bigint").alias("n"),
                    )
                    for d, v in zeros
                ]
            )
        )
    )
    return found.unionByName(empty).groupBy("dimension", "key").agg(F.sum("n").alias("n"))


def _numbers() -> list[Column]:
    def pick(name: str, column: Column) -> Column:
        return F.coalesce(F.max(F.when(F.col("dimension") == name, column)), F.lit(0.0))

    out = []
    for name in _NUMBERS:
        out += [
            round2(pick(name, F.col("lo"))).alias(f"{name}_min"),
            round2(pick(name, F.col("hi"))).alias(f"{name}_max"),
            round2(pick(name, F.col("total") / F.col("n"))).alias(f"{name}_avg"),
        ]
    return out


def numbers(merged: DataFrame) -> DataFrame:
    """One row with minimum, maximum and mean of each number, and the p95."""
    frequencies = merged.where(F.col("dimension") == _VALUES).select(
        F.col("key").cast("bigint").alias("key"), "n"
    )
    p95 = value_at_share(frequencies, 0.95)
    return merged.agg(*_numbers()).withColumn("response_time_p95", p95.scalar())


def count_map(buckets: DataFrame, name: str = "counts") -> DataFrame:
    """``(key, n)`` rows as one map; for fixed lists and tables cut to a size."""
    return buckets.agg(F.map_from_entries(F.collect_list(F.struct("key", "n"))).alias(name))


def snapshot(merged: DataFrame) -> DataFrame:
    """One row: total, error count, six maps, and the numbers.

    The maps of the fixed lists hold every value, those of services, places and
    tags every key found; with keys too many for one row, ``counts`` has the same
    in long form. ``merged`` is computed once: the fixed part, the open maps and
    the percentile all read the same aggregate.
    """
    fixed = {"level": LEVELS, "environment": ENVIRONMENTS, "category": CATEGORIES}

    def count(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0)).cast("bigint")

    def of(name: str, values: list[str]) -> Column:
        mine = F.col("dimension") == name
        counted = [count(mine & (F.col("key") == v)) for v in values]
        other = count(mine & ~F.col("key").isin(values))
        full = F.map_from_arrays(
            F.array(*[F.lit(v) for v in [*values, "other"]]), F.array(*counted, other)
        )
        return F.map_filter(full, lambda k, v: (k != "other") | (v > 0))

    out = [
        count(F.col("dimension") == "total").alias("total_generated"),
        count(F.col("dimension") == "errors").alias("error_count"),
        *[of(name, values).alias(f"{name}_counts") for name, values in fixed.items()],
    ]
    row = merged.agg(*out, *_numbers())
    same = _kept_together(F.col("dimension") == _VALUES)
    # tied to a counted column, so that filters on it stay above the aggregate
    value = F.when(F.col("n") > 0, F.col("key").try_cast("bigint"))
    frequencies = merged.where(same).select(value.alias("key"), "n")
    open_fields = {"service": "service_counts", "geo": "geo_counts", "tag": "tag_counts"}
    listed = (
        merged.where(_kept_together(F.col("dimension").isin(list(open_fields))))
        .groupBy()
        .agg(
            *[
                F.map_from_entries(
                    F.collect_list(F.when(F.col("dimension") == d, F.struct("key", "n")))
                ).alias(name)
                for d, name in open_fields.items()
            ]
        )
    )
    maps = listed.select(F.struct(*listed.columns).alias("maps")).scalar()
    return (
        row.withColumn("response_time_p95", value_at_share(frequencies, 0.95).scalar())
        .withColumn("maps", maps)
        .select("*", "maps.*")
        .drop("maps")
    )


def _kept_together(condition: Column) -> Column:
    """A condition on the groups that names every counted column.

    A plain one would go below the aggregation, and columns nobody names would
    be left out of it; the branches of a snapshot would then each count anew.
    """
    named = [F.col(c).isNull() for c in ("n", "lo", "hi", "total")]
    return F.when(named[0] & named[1] & named[2] & named[3], F.lit(False)).otherwise(condition)
