"""Bucket counts, statistics, percentiles and rates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import predicates
from ..functions.scalars import col, round2


def count_by(df: DataFrame, key: Column | str) -> DataFrame:
    """``(key, n)`` for every value present."""
    return (
        df.select(col(key).alias("key"))
        .where(F.col("key").isNotNull())
        .groupBy("key")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def top(buckets: DataFrame, size: int) -> DataFrame:
    """The largest buckets; equal counts in key order."""
    return buckets.orderBy(F.col("n").desc(), F.col("key").asc()).limit(size)


def terms(
    df: DataFrame, key: Column | str, size: int = 10, include: list[str] | None = None
) -> DataFrame:
    """Top ``size`` values of a field by exact count, optionally of a given list."""
    if include is not None:
        df = df.where(col(key).isin(include))
        size = len(include)
    return top(count_by(df, key), size)


def level_distribution(logs: DataFrame, levels: list[str] | None = None) -> DataFrame:
    return terms(logs, "level", 10, levels)


def top_services(logs: DataFrame, size: int = 10) -> DataFrame:
    return terms(logs, "service.name", size)


def top_error_services(logs: DataFrame, size: int = 10) -> DataFrame:
    return terms(logs.where(predicates.critical_level()), "service.name", size)


def critical_counts(logs: DataFrame) -> DataFrame:
    return logs.agg(
        F.count_if(F.col("level") == "error").alias("error"),
        F.count_if(F.col("level") == "fatal").alias("fatal"),
        F.count_if(predicates.critical_level()).alias("total"),
    )


def stats(df: DataFrame, value: Column | str) -> DataFrame:
    """count, min, max, avg and sum of a number; 0 where there is no value."""
    v = col(value).cast("double")
    zero = F.lit(0.0)
    return df.agg(
        F.count(v).alias("count"),
        F.coalesce(F.min(v), zero).alias("min"),
        F.coalesce(F.max(v), zero).alias("max"),
        F.coalesce(F.avg(v), zero).alias("avg"),
        F.coalesce(F.sum(v), zero).alias("sum"),
    )


def performance(logs: DataFrame) -> DataFrame:
    m = F.col("metrics")
    zero = F.lit(0.0)
    return logs.agg(
        F.coalesce(F.avg(m["response_time_ms"]), zero).alias("avg_response_time"),
        F.coalesce(F.max(m["response_time_ms"]).cast("double"), zero).alias(
            "max_response_time"
        ),
        F.coalesce(F.avg(m["cpu_usage"]), zero).alias("avg_cpu_usage"),
        F.coalesce(F.avg(m["memory_mb"]), zero).alias("avg_memory_usage"),
    )


def domain(spark: SparkSession, values: list[str]) -> DataFrame:
    """A fixed list as a one-column table, built on the JVM side."""
    return spark.range(1).select(
        F.explode(F.array(*[F.lit(v) for v in values])).alias("key")
    )


def zero_filled(df: DataFrame, key: Column | str, values: list[str]) -> DataFrame:
    """Counts over a fixed list, 0 where absent; anything else under ``other``."""
    k = col(key)
    known = F.when(k.isin(values), k).otherwise(F.lit("other"))
    counts = count_by(df, known)
    zeros = domain(df.sparkSession, values).select("key", F.lit(0).cast("bigint").alias("n"))
    return counts.unionByName(zeros).groupBy("key").agg(F.sum("n").alias("n"))


def tag_counts(logs: DataFrame) -> DataFrame:
    return count_by(logs.select(F.explode("tags").alias("tag")), "tag")


def geo_counts(logs: DataFrame) -> DataFrame:
    return count_by(logs, F.concat(F.col("geo.country"), F.lit("|"), F.col("geo.city")))


def error_object_count(logs: DataFrame) -> DataFrame:
    return logs.agg(F.count_if(predicates.error_object()).alias("error_count"))


def total(logs: DataFrame) -> DataFrame:
    return logs.agg(F.count(F.lit(1)).alias("n"))


def error_rate_by_environment(logs: DataFrame, size: int = 10) -> DataFrame:
    """Errors are records whose ``error`` exists; the rate is a percentage."""
    return (
        logs.where(F.col("service.environment").isNotNull())
        .groupBy(F.col("service.environment").alias("environment"))
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.count_if(predicates.error_exists()).alias("error_count"),
        )
        .orderBy(F.col("total").desc(), F.col("environment").asc())
        .limit(size)
        .withColumn(
            "error_rate",
            F.round(
                F.col("error_count").cast("decimal(20,0)") * 100 / F.col("total"), 2
            ).cast("double"),
        )
    )


PERCENTS = [50, 75, 90, 95, 99]


def percentiles(
    df: DataFrame, value: Column | str, percents: list[int] = PERCENTS, exact: bool = True, accuracy: int = 10_000
) -> DataFrame:
    """Interpolated percentiles, one row per percent; none where there is no value.

    The approximate form keeps a sketch of bounded size, whose ranks are right
    up to one part in ``accuracy``. The exact form takes such sketches for the
    bounds between which each percentile must lie, and then counts: how many
    values are below, and how often each value between the bounds occurs. Two
    scans, whatever the distribution; only the few values between the bounds are shuffled.
    """
    v = col(value).cast("double")
    if exact:
        return _exact_percentiles(df.select(v.alias("v")).where(F.col("v").isNotNull()), percents, accuracy)
    points = F.array(*[F.lit(p / 100.0) for p in percents])
    values = F.percentile_approx(col(value), points, accuracy)
    pairs = F.arrays_zip(
        F.array(*[F.lit(float(p)) for p in percents]).alias("percent"), values.alias("value")
    )
    return (
        df.agg(pairs.alias("pairs"))
        .select(F.inline("pairs").alias("percent", "value"))
        .withColumn("value", F.col("value").cast("double"))
    )


def _exact_percentiles(values: DataFrame, percents: list[int], accuracy: int) -> DataFrame:
    """Percent ``p`` lies at position ``(n - 1) * p / 100`` of the sorted values,
    between two of them as a rule.

    Each value falls into a cell: itself if it is between the bounds of a
    percentile, else the gap below the next bounds. Cells in their order have
    running counts, taken by ``gap`` first and inside a gap then, so that no window sees more
    than the values between the bounds of one percentile.
    """
    ordered = sorted(percents)
    margin = 4.0 / accuracy
    low = [max(0.0, p / 100.0 - margin) for p in ordered]
    high = [min(1.0, p / 100.0 + margin) for p in ordered]
    quantiles = F.percentile_approx("v", F.array(*[F.lit(x) for x in low + high]), F.lit(accuracy))
    # up to so many values the error is below one rank, and all lie between the bounds
    few = F.count(F.lit(1)) <= 2 * accuracy
    k = len(ordered)
    bounds = values.agg(
        F.struct(
            F.count(F.lit(1)).alias("rows"),
            F.transform(F.sequence(F.lit(1), F.lit(k)), lambda i: F.when(few, F.min("v")).otherwise(F.element_at(quantiles, i))).alias("lo"),
            F.transform(F.sequence(F.lit(1), F.lit(k)), lambda i: F.when(few, F.max("v")).otherwise(F.element_at(quantiles, i + k))).alias("hi"),
        ).alias("b")
    )
    v, b = F.col("v"), F.col("b")
    gap = reduce(Column.__add__, [(b["hi"][i] < v).cast("int") for i in range(k)])
    between = reduce(Column.__or__, [(b["lo"][i] <= v) & (v <= b["hi"][i]) for i in range(k)])
    cells = (
        values.withColumn("b", bounds.scalar())
        .select(gap.alias("gap"), F.when(between, v).alias("key"), b["rows"].alias("rows"))
        .groupBy("gap", "key")
        .agg(F.count(F.lit(1)).alias("n"), F.max("rows").alias("rows"))
    )
    gaps = cells.groupBy("gap").agg(F.sum("n").alias("n"))
    gaps = gaps.select("gap", (F.sum("n").over(W.orderBy("gap")) - F.col("n")).alias("before"))
    upto = F.col("before") + F.sum("n").over(W.partitionBy("gap").orderBy(F.col("key").asc_nulls_first()))
    # at most one gap more than there are percents
    placed = cells.join(F.broadcast(gaps), "gap").select("key", "n", "rows", upto.alias("upto"))
    wanted = F.array(
        *[
            F.struct(
                F.lit(p).alias("percent"),
                side(F.col("rows").cast("double") * p / 100.0 - p / 100.0).cast("bigint").alias("position"),
            )
            for p in percents
            for side in (F.floor, F.ceil)
        ]
    )
    found = (
        placed.select("key", "n", "upto", "rows", F.inline(wanted))
        .where((F.col("upto") - F.col("n") <= F.col("position")) & (F.col("position") < F.col("upto")))
    )
    point = F.max("rows").cast("double") * F.col("percent") / 100.0 - F.col("percent") / 100.0
    lower, upper = F.min("key"), F.max("key")
    return found.groupBy("percent").agg(
        (lower + (point - F.floor(point)) * (upper - lower)).alias("value")
    ).select(F.col("percent").cast("double").alias("percent"), "value")


def value_frequencies(df: DataFrame, value: Column | str) -> DataFrame:
    return count_by(df, col(value).cast("bigint"))


_SPAN = 4096


def value_at_share(frequencies: DataFrame, share: float = 0.95) -> DataFrame:
    """The value at sorted position ``min(floor(n * share), n - 1)``; 0 without rows.

    Works on a ``(key, n)`` frequency table of whole numbers. The running count
    goes over spans of 4096 values first and then inside the one span that holds
    the position, so neither window sees all distinct values at once.
    """
    # the join would infer this filter for one of the two uses only; with it on
    # both, Spark computes the table once
    spanned = frequencies.withColumn("span", F.floor(F.col("key") / _SPAN)).where(
        F.col("span").isNotNull()
    )
    spans = spanned.groupBy("span").agg(F.sum("n").alias("n"))
    by_span = W.orderBy("span")
    everything = W.partitionBy()
    total_n = F.sum("n").over(everything)
    located = (
        spans.select(
            "span",
            "n",
            (F.sum("n").over(by_span) - F.col("n")).alias("before"),
            F.least(F.floor(total_n * share), total_n - 1).alias("position"),
        )
        .where(
            (F.col("before") <= F.col("position"))
            & (F.col("position") < F.col("before") + F.col("n"))
        )
        .select("span", (F.col("position") - F.col("before")).alias("position"))
    )
    inside = spanned.join(F.broadcast(located), "span")
    seen = F.sum("n").over(W.orderBy("key"))
    found = inside.select("key", "position", seen.alias("seen")).where(
        F.col("seen") > F.col("position")
    )
    return found.agg(F.coalesce(F.min("key"), F.lit(0)).alias("value"))


def p95(df: DataFrame, value: Column | str) -> DataFrame:
    return value_at_share(value_frequencies(df, value), 0.95).select(
        F.col("value").alias("p95")
    )


def summary(df: DataFrame, value: Column | str) -> DataFrame:
    """min, max and avg with two decimals; 0 without rows."""
    v = col(value)
    return df.agg(
        round2(F.coalesce(F.min(v), F.lit(0))).alias("min"),
        round2(F.coalesce(F.max(v), F.lit(0))).alias("max"),
        round2(F.coalesce(F.avg(v), F.lit(0))).alias("avg"),
    )


def errors_by_type(rejects: DataFrame) -> DataFrame:
    return count_by(rejects, "error_type")


def dimension_counts(df: DataFrame, dimensions: dict[str, Column]) -> DataFrame:
    """Counts of several fields in one pass: ``(dimension, key, n)``.

    Each row is unfolded into one small row per field, and the partial
    aggregation folds them again before anything is shuffled.
    """
    rows = F.array(
        *[
            F.struct(F.lit(name).alias("dimension"), c.cast("string").alias("key"))
            for name, c in dimensions.items()
        ]
    )
    return (
        df.select(F.inline(rows))
        .where(F.col("key").isNotNull())
        .groupBy("dimension", "key")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def top_per_dimension(counts: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """The largest keys of each dimension, with their rank."""
    largest = max(sizes.values())
    order = W.partitionBy("dimension").orderBy(F.col("n").desc(), F.col("key").asc())
    limit = F.element_at(
        F.create_map(*[F.lit(x) for kv in sizes.items() for x in kv]), F.col("dimension")
    )
    # the constant bound lets every task cut its own rows before the shuffle
    return (
        counts.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= largest)
        .where(F.col("rank") <= limit)
    )
