"""The shared test tables seen as log records and as a text corpus.

``events`` holds no logs, so every log field is derived from its columns by
fixed expressions; each event becomes one record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import choose
from ..schema import (
    API_PATHS,
    CITIES,
    COUNTRIES,
    DEFAULT_API_PATH,
    ERROR_MESSAGES,
    ERROR_TYPES,
    HTTP_METHODS,
    CURRENCIES,
    LEVEL_WEIGHTS,
    LEVELS,
    MESSAGES,
    PAYMENT_METHODS,
    REGIONS,
    SERVICE_WEIGHTS,
    SERVICES,
)


def by_weight(values: list[str], weights: list[int], point: Column) -> Column:
    """The value whose cumulative weight first exceeds ``point``."""
    chain, upper = None, 0
    for value, weight in zip(values[:-1], weights):
        upper += weight
        cond, lit = point < upper, F.lit(value)
        chain = F.when(cond, lit) if chain is None else chain.when(cond, lit)
    return chain.otherwise(F.lit(values[-1]))


def by_key(key: Column, options: dict[str, list[str]], index: Column, default=None) -> Column:
    """One of ``options[key]``, picked by ``index`` modulo the list length."""
    chain = None
    for name, values in options.items():
        pick = choose(values, index % len(values))
        cond = key == name
        chain = F.when(cond, pick) if chain is None else chain.when(cond, pick)
    return chain if default is None else chain.otherwise(F.lit(default))


def message_for(level: Column, service: Column, index: Column) -> Column:
    text = by_key(level, MESSAGES, index)
    return F.replace(text, F.lit("{service}"), service)


def logs_from_events(events: DataFrame) -> DataFrame:
    """Derive one log record per row of ``events``."""
    n = F.col("event_id")
    u = F.col("user_id")
    hundreds = F.floor(n / 100)
    base = events.select(
        n,
        u,
        "ts",
        "value",
        "props",
        "event_type",
        by_weight(SERVICES, SERVICE_WEIGHTS, u % 100).alias("svc"),
        by_weight(LEVELS, LEVEL_WEIGHTS, n % 100).alias("level"),
        choose(ERROR_TYPES, n % len(ERROR_TYPES)).alias("etype"),
    )
    svc, level, etype = F.col("svc"), F.col("level"), F.col("etype")
    critical = level.isin("error", "fatal")
    category = (
        F.when(F.col("event_type") == "click", "application")
        .when(F.col("event_type") == "signup", "security")
        .when(F.col("event_type") == "purchase", "performance")
        .when(F.col("event_type") == "view", "audit")
        .when(F.col("event_type") == "error", "system")
    )
    environment = (
        F.when(hundreds % 10 < 7, "production")
        .when(hundreds % 10 < 9, "staging")
        .otherwise("development")
    )
    return base.select(
        n.cast("string").alias("id"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.struct(
            svc.alias("name"),
            F.concat_ws(".", 1 + n % 3, n % 10, n % 21).alias("version"),
            environment.alias("environment"),
            F.concat(F.lit("i-"), F.lpad(u.cast("string"), 10, "0")).alias("instance_id"),
            F.concat(F.lit("ip-10-0-0-"), (u % 256).cast("string"), F.lit(".internal")).alias(
                "host"
            ),
            choose(REGIONS, u % len(REGIONS)).alias("region"),
        ).alias("service"),
        level,
        category.alias("category"),
        message_for(level, svc, hundreds).alias("message"),
        F.when(
            critical,
            F.struct(
                etype.alias("type"),
                by_key(etype, ERROR_MESSAGES, hundreds).alias("message"),
                F.concat(etype, F.lit(": Error in "), svc).alias("stack_trace"),
                F.concat_ws("_", F.upper(F.substring(etype, 1, 2)), 1000 + n % 9000).alias(
                    "code"
                ),
            ),
        ).alias("error"),
        F.when(
            n % 5 != 0,
            F.struct(
                F.concat(F.lit("req-"), n.cast("string")).alias("id"),
                choose(HTTP_METHODS, n % len(HTTP_METHODS)).alias("method"),
                by_key(svc, API_PATHS, n, DEFAULT_API_PATH).alias("path"),
                F.concat(F.lit("user-"), u.cast("string")).alias("user_id"),
                F.concat(F.lit("10.0."), (u % 256).cast("string"), F.lit(".1")).alias("ip"),
                F.lit("log-client").alias("user_agent"),
                (50 + F.floor(F.col("value") * 20)).cast("int").alias("duration_ms"),
            ),
        ).alias("request"),
        F.when(
            (svc == "payment-service") & (n % 10 < 7),
            F.struct(
                F.concat(F.lit("txn-"), n.cast("string")).alias("transaction_id"),
                F.col("value").cast("decimal(18,2)").alias("amount"),
                choose(CURRENCIES, u % len(CURRENCIES)).alias("currency"),
                choose(PAYMENT_METHODS, n % len(PAYMENT_METHODS)).alias("payment_method"),
            ),
        ).alias("business"),
        F.struct(
            F.regexp_extract("props", r"(\d+)", 1).cast("double").alias("cpu_usage"),
            (128 + (n * 7919) % 1921).cast("int").alias("memory_mb"),
            (10 + F.floor(F.col("value") * 10)).cast("int").alias("response_time_ms"),
            (5 + n % 496).cast("int").alias("db_query_time_ms"),
        ).alias("metrics"),
        F.concat(
            F.array(svc),
            F.when(critical, F.array(F.lit("critical"))).otherwise(F.array().cast("array<string>")),
            F.when(n % 10 < 3, F.array(F.lit("monitoring"))).otherwise(
                F.array().cast("array<string>")
            ),
        ).alias("tags"),
        F.struct(
            choose(COUNTRIES, u % len(COUNTRIES)).alias("country"),
            choose(CITIES, u % len(CITIES)).alias("city"),
            F.struct(
                (u % 181 - 90).cast("double").alias("lat"),
                (u * 7 % 361 - 180).cast("double").alias("lon"),
            ).alias("location"),
        ).alias("geo"),
    )


def load_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def load_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs_from_events(load_events(spark, sf_dir))


def dealt_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events on all cores, however few row groups their file has.

    For jobs with much work on each row; only the narrow events are shuffled. A kept
    table has as many parts as are named here, so there is one for each core.
    """
    return load_events(spark, sf_dir).repartition(spark.sparkContext.defaultParallelism, "event_id")


def dealt_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs_from_events(dealt_events(spark, sf_dir))


def load_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text corpus."""
    columns = ["doc_id", "text", "lang", "source"]
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns)
