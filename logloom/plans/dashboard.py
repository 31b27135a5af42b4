"""The dashboard: ten aggregations over one scan, as one long table."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import predicates
from ..functions.scalars import iso_utc
from ..operators.filters import last_days
from ..operators.histogram import bucket_millis, every_bucket

TERM_SIZES = {
    "by_level": 10,
    "by_service": 20,
    "by_category": 10,
    "top_error_services": 10,
    "geographic": 10,
}
_SERIES = "time_series"
_ALL = "all"


def bucket_interval(days: int) -> str:
    return "1h" if days == 1 else "1d"


def _unfold(logs: DataFrame, interval: str) -> DataFrame:
    m = F.col("metrics")
    keys = {
        "by_level": F.col("level"),
        "by_service": F.col("service.name"),
        "by_category": F.col("category"),
        "top_error_services": F.when(predicates.critical_level(), F.col("service.name")),
        "geographic": F.col("geo.country"),
        _SERIES: bucket_millis("timestamp", interval).cast("string"),
        _ALL: F.lit(""),
    }
    numbers = {"rt": "response_time_ms", "cpu": "cpu_usage", "mem": "memory_mb"}

    def row(section: str, key: Column) -> Column:
        values = [
            (m[src].cast("double") if section == _ALL else F.lit(None).cast("double")).alias(n)
            for n, src in numbers.items()
        ]
        return F.struct(F.lit(section).alias("section"), key.alias("key"), *values)

    rows = F.array(*[row(s, k) for s, k in keys.items()])
    return logs.select(F.inline(rows)).where(F.col("key").isNotNull())


def dashboard(logs: DataFrame, interval: str = "1h") -> DataFrame:
    """``(section, position, key, value)`` of all ten aggregations.

    One scan and one aggregation by (section, key) feed everything; what follows
    works on the counted keys only.
    """
    counted = (
        _unfold(logs, interval)
        .groupBy("section", "key")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg("rt").alias("avg_rt"),
            F.max("rt").alias("max_rt"),
            F.avg("cpu").alias("avg_cpu"),
            F.avg("mem").alias("avg_mem"),
        )
    )
    # Cut each terms section to its size. Every time bucket is a group of its
    # own, so none is cut.
    series = F.col("section") == _SERIES
    order = W.partitionBy("section", F.when(series, F.col("key"))).orderBy(
        F.col("n").desc(), F.col("key").asc()
    )
    size = F.element_at(
        F.create_map(*[F.lit(x) for kv in TERM_SIZES.items() for x in kv]), F.col("section")
    )
    kept = (
        counted.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= max(TERM_SIZES.values()))
        .where(F.col("rank") <= F.coalesce(size, F.lit(1)))
    )
    at = F.when(series, F.col("key").cast("bigint"))
    kept = kept.withColumn("at", at)

    def out(section: str, key: Column | str, value: Column, position: Column) -> Column:
        k = F.lit(key) if isinstance(key, str) else key
        return F.struct(
            F.lit(section).alias("section"),
            position.cast("bigint").alias("position"),
            k.alias("key"),
            value.cast("double").alias("value"),
        )

    n, zero, none = F.col("n"), F.lit(0), F.array().cast(
        "array<struct<section:string,position:bigint,key:string,value:double>>"
    )
    itself = F.array(
        F.struct(
            F.col("section"),
            F.col("rank").cast("bigint").alias("position"),
            F.col("key"),
            n.cast("double").alias("value"),
        )
    )
    of_level = F.when(
        F.col("key").isin("error", "fatal"),
        F.array(
            F.struct(
                F.lit("critical_logs").alias("section"),
                F.when(F.col("key") == "error", 1).otherwise(2).cast("bigint").alias("position"),
                F.col("key"),
                n.cast("double").alias("value"),
            ),
            out("critical_logs", "total", n, F.lit(3)),
        ),
    ).otherwise(none)
    overall = F.array(
        out("total_logs", "total", n, F.lit(1)),
        out("performance", "avg_response_time", F.coalesce("avg_rt", zero), F.lit(1)),
        out("performance", "max_response_time", F.coalesce("max_rt", zero), F.lit(2)),
        out("performance", "avg_cpu_usage", F.coalesce("avg_cpu", zero), F.lit(3)),
        out("performance", "avg_memory_usage", F.coalesce("avg_mem", zero), F.lit(4)),
    )
    bucket_key = iso_utc(F.timestamp_millis(F.col("at")))
    rows = (
        F.when(F.col("section") == _ALL, overall)
        .when(series, F.array(out(_SERIES, bucket_key, n, zero)))
        .when(F.col("section") == "by_level", F.concat(itself, of_level))
        .otherwise(itself)
    )
    # figures that are reported even where no record matches
    zeros = [
        ("total_logs", ["total"]),
        ("critical_logs", ["error", "fatal", "total"]),
        (
            "performance",
            ["avg_response_time", "max_response_time", "avg_cpu_usage", "avg_memory_usage"],
        ),
    ]
    always = logs.sparkSession.range(1).select(
        F.inline(
            F.array(
                *[
                    out(section, key, zero, F.lit(i + 1))
                    for section, names in zeros
                    for i, key in enumerate(names)
                ]
            )
        )
    )
    # Every bucket of the span with its position and a zero. All counted columns
    # are looked at only to keep this branch on the same aggregate as the rows
    # above, which Spark then computes once.
    seen = ["n", "avg_rt", "max_rt", "avg_cpu", "avg_mem"]
    span = counted.agg(
        F.min(at).alias("lo"), F.max(at).alias("hi"), *[F.max(c).alias(c) for c in seen]
    ).where(F.col("lo").isNotNull() & F.coalesce(*[F.col(c).cast("double") for c in seen]).isNotNull())
    empty = every_bucket(span, interval).select(
        F.lit(_SERIES).alias("section"),
        "position",
        iso_utc(F.timestamp_millis("bucket")).alias("key"),
        F.lit(0.0).alias("value"),
    )
    return (
        kept.select(F.inline(rows))
        .unionByName(always)
        .unionByName(empty)
        .groupBy("section", "key")
        .agg(F.max("position").alias("position"), F.sum("value").alias("value"))
        .select("section", "position", "key", "value")
    )


def fetch_analytics(logs: DataFrame, days: int, as_of: str | int | datetime) -> DataFrame:
    """The dashboard of the last ``days`` days before ``as_of``, in display order."""
    interval = bucket_interval(days)
    return dashboard(last_days(logs, days, as_of), interval).orderBy("section", "position")


# The chart report has no performance figures and no critical counts of its own.
CHART_SECTIONS = ["by_level", "by_service", "by_category", "top_error_services", "geographic", _SERIES]


def fetch_chart_data(logs: DataFrame, days: int, as_of: str | int | datetime) -> DataFrame:
    """The tables behind the six charts."""
    return fetch_analytics(logs, days, as_of).where(F.col("section").isin(CHART_SECTIONS))


def log_aggregations(logs: DataFrame, interval: str = "1h") -> DataFrame:
    """The API's three aggregations and the total, in the same long form."""
    wanted = ["by_level", "by_service", _SERIES, "total_logs"]
    return dashboard(logs, interval).where(F.col("section").isin(wanted))
