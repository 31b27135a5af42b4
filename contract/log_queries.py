"""Filters, pages, aggregates, histograms, charts and the dashboard."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom import schema as S
from logloom.functions import predicates
from logloom.functions.scalars import chart_label, iso_utc, keyword, table_name
from logloom.operators import aggregates as A
from logloom.operators import filters as FI
from logloom.operators import histogram as H
from logloom.operators import paging as P
from logloom.operators import reports as R
from logloom.plans import dashboard as D
from logloom.sources.events import load_logs

from .ingest_queries import shared_table
from .registry import query
from .sql import iso, iso_ms, sql_list, with_logs


def _brief(df: DataFrame) -> DataFrame:
    return df.select(
        "id",
        iso_utc("timestamp").alias("timestamp"),
        F.col("service.name").alias("service"),
        "level",
        "category",
        "message",
        F.col("metrics.response_time_ms").alias("response_time_ms"),
    )


BRIEF = f"id, {iso('ts')} AS timestamp, service, level, category, message, response_time_ms"


def _brief_sql(where: str) -> str:
    return with_logs(f"SELECT {BRIEF} FROM logs WHERE {where}")


@query(
    "logs_view",
    with_logs(
        f"""SELECT {BRIEF}, environment, version, error_type, error_message, error_code,
        request_path, duration_ms, amount::DOUBLE AS amount, cpu_usage, memory_mb,
        db_query_time_ms, array_to_string(tags, ',') AS tags, country, city, lat, lon FROM logs"""
    ),
)
def logs_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = load_logs(spark, sf_dir)
    return logs.select(
        "id",
        iso_utc("timestamp").alias("timestamp"),
        F.col("service.name").alias("service"),
        "level",
        "category",
        "message",
        "metrics.response_time_ms",
        "service.environment",
        "service.version",
        F.col("error.type").alias("error_type"),
        F.col("error.message").alias("error_message"),
        F.col("error.code").alias("error_code"),
        F.col("request.path").alias("request_path"),
        "request.duration_ms",
        F.col("business.amount").cast("double").alias("amount"),
        "metrics.cpu_usage",
        "metrics.memory_mb",
        "metrics.db_query_time_ms",
        F.array_join("tags", ",").alias("tags"),
        "geo.country",
        "geo.city",
        "geo.location.lat",
        "geo.location.lon",
    )


# -- filters ---------------------------------------------------------------------


def _filtered(name: str, filters: FI.LogFilters, where: str) -> None:
    @query(name, _brief_sql(where))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _brief(FI.apply_filters(load_logs(spark, sf_dir), filters))


_filtered("filter_none", FI.LogFilters(), "true")
_filtered(
    "filter_time_range",
    FI.LogFilters(start_date="2024-01-10T06:30:00Z", end_date="2024-01-20"),
    "ts >= TIMESTAMP '2024-01-10 06:30:00' AND ts < TIMESTAMP '2024-01-21'",
)
_filtered(
    "filter_start_only",
    FI.LogFilters(start_date="2024-01-25"),
    "ts >= TIMESTAMP '2024-01-25'",
)
_filtered(
    "filter_levels", FI.LogFilters(levels=["warn", "error"]), "level IN ('warn', 'error')"
)
_filtered(
    "filter_services",
    FI.LogFilters(services=["payment-service", "api-gateway"]),
    "service IN ('payment-service', 'api-gateway')",
)
_filtered(
    "filter_environments",
    FI.LogFilters(environments=["staging", "development"]),
    "environment IN ('staging', 'development')",
)
_filtered(
    "filter_categories",
    FI.LogFilters(categories=["security", "system"]),
    "category IN ('security', 'system')",
)
_filtered(
    "filter_response_time",
    FI.LogFilters(min_response_time=500, max_response_time=1500),
    "response_time_ms BETWEEN 500 AND 1500",
)
_filtered(
    "filter_zero_bound",
    FI.LogFilters(min_response_time=0, max_response_time=100),
    "response_time_ms <= 100",
)
_filtered("has_error", FI.LogFilters(has_error=True), "error_type IS NOT NULL")
_filtered("no_error", FI.LogFilters(has_error=False), "error_type IS NULL")
_filtered(
    "filter_combo",
    FI.LogFilters(
        levels=["info", "warn", "error", "fatal"],
        services=["api-gateway", "auth-service", "payment-service"],
        environments=["production"],
        categories=["application", "audit", "system"],
        start_date="2024-01-05",
        end_date="2024-01-28T12",
        min_response_time=200,
        max_response_time=3000,
        has_error=False,
    ),
    """level IN ('info', 'warn', 'error', 'fatal') AND environment = 'production'
    AND service IN ('api-gateway', 'auth-service', 'payment-service')
    AND category IN ('application', 'audit', 'system')
    AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-28 13:00:00'
    AND response_time_ms BETWEEN 200 AND 3000 AND error_type IS NULL""",
)


@query("lookup_id", _brief_sql("id = '77'"))
def lookup_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On the written table, whose Bloom filters spare files without the id."""
    return _brief(FI.lookup(shared_table(spark, sf_dir), "77"))


@query(
    "last_days",
    _brief_sql(
        "ts >= TIMESTAMP '2024-01-23 12:00:00' AND ts < TIMESTAMP '2024-01-30 12:00:00.001'"
    ),
)
def last_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _brief(FI.last_days(load_logs(spark, sf_dir), 7, "2024-01-30T12:00:00Z"))


@query("slow_requests", _brief_sql("response_time_ms >= 2000"))
def slow_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _brief(FI.slow_requests(load_logs(spark, sf_dir)))


SLOW_PATHS = [
    "timestamp", "service.name", "request.path", "metrics.response_time_ms", "level"
]


@query(
    "slowest_projected",
    with_logs(
        f"""SELECT id, {iso('ts')} AS timestamp, service, request_path, response_time_ms, level
        FROM logs WHERE response_time_ms >= 2000
        ORDER BY response_time_ms DESC, id LIMIT 5"""
    ),
)
def slowest_projected(spark: SparkSession, sf_dir: str) -> DataFrame:
    slow = P.slowest(FI.slow_requests(load_logs(spark, sf_dir)))
    return FI.project(slow, ["id", *SLOW_PATHS]).select(
        "id",
        iso_utc("timestamp").alias("timestamp"),
        F.col("service.name").alias("service"),
        F.col("request.path").alias("request_path"),
        "metrics.response_time_ms",
        "level",
    )


@query("fatal_logs", _brief_sql("level = 'fatal'"))
def fatal_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _brief(FI.fatal_logs(load_logs(spark, sf_dir)))


@query(
    "error_filter_count",
    with_logs("SELECT count(*) AS n FROM logs WHERE level IN ('error', 'fatal')"),
)
def error_filter_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.total(load_logs(spark, sf_dir).where(predicates.critical_level()))


@query(
    "message_keyword_counts",
    with_logs(
        "SELECT message AS key, count(*) AS n FROM logs WHERE length(message) <= 256 GROUP BY 1"
    ),
)
def message_keyword_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.count_by(load_logs(spark, sf_dir), keyword("message"))


@query(
    "document_keywords",
    """SELECT doc_id, CASE WHEN length(text) <= 256 THEN text END AS keyword FROM documents""",
)
def document_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", keyword("text").alias("keyword"))


# -- pages -----------------------------------------------------------------------


@query("logs_page", with_logs(f"SELECT {BRIEF} FROM logs ORDER BY ts DESC, id LIMIT 20 OFFSET 40"))
def logs_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _brief(P.page_rows(load_logs(spark, sf_dir), 20, 40))


@query(
    "logs_page_info",
    with_logs(
        """SELECT count(*) AS total, 60 < count(*) AS has_next_page, true AS has_previous_page
        FROM logs WHERE level = 'warn'"""
    ),
)
def logs_page_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    warn = FI.apply_filters(load_logs(spark, sf_dir), FI.LogFilters(levels=["warn"]))
    return P.page_info(warn, 20, 40)


# -- counts ----------------------------------------------------------------------


def _terms_sql(key: str, size: int, where: str = "true") -> str:
    return with_logs(
        f"""SELECT {key} AS key, count(*) AS n FROM logs WHERE {where} GROUP BY 1
        ORDER BY n DESC, key LIMIT {size}"""
    )


@query("level_distribution", _terms_sql("level", 10))
def level_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.level_distribution(load_logs(spark, sf_dir))


@query("fatal_vs_error", _terms_sql("level", 2, "level IN ('error', 'fatal')"))
def fatal_vs_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.level_distribution(load_logs(spark, sf_dir), ["error", "fatal"])


@query("top_services", _terms_sql("service", 10))
def top_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.top_services(load_logs(spark, sf_dir))


@query("top_countries", _terms_sql("country", 10))
def top_countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.terms(load_logs(spark, sf_dir), "geo.country", 10)


@query("category_counts", _terms_sql("category", 10))
def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.terms(load_logs(spark, sf_dir), "category", 10)


@query("top_error_services", _terms_sql("service", 10, "critical"))
def top_error_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.top_error_services(load_logs(spark, sf_dir))


@query(
    "critical_counts",
    with_logs(
        """SELECT count(*) FILTER (level = 'error') AS error,
        count(*) FILTER (level = 'fatal') AS fatal, count(*) FILTER (critical) AS total FROM logs"""
    ),
)
def critical_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.critical_counts(load_logs(spark, sf_dir))


def _zero_filled(name: str, path: str, column: str, values: list[str]) -> None:
    @query(
        name,
        with_logs(
            f"""SELECT key, coalesce(n, 0) AS n FROM (SELECT unnest({sql_list(values)}) AS key)
            FULL JOIN (SELECT CASE WHEN {column} IN (SELECT unnest({sql_list(values)}))
              THEN {column} ELSE 'other' END AS key, count(*) AS n
              FROM logs GROUP BY 1) USING (key)"""
        ),
    )
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return A.zero_filled(load_logs(spark, sf_dir), path, values)


# each domain has a value that no record has
_zero_filled("level_counts_zero_filled", "level", "level", [*S.LEVELS, "silent"])
_zero_filled(
    "environment_counts_zero_filled", "service.environment", "environment", [*S.ENVIRONMENTS, "lab"]
)
_zero_filled("category_counts_zero_filled", "category", "category", [*S.CATEGORIES, "billing"])
# a domain that lacks some of the values present
_zero_filled("level_counts_with_other", "level", "level", ["info", "fatal"])


@query("tag_counts", with_logs("SELECT unnest(tags) AS key, count(*) AS n FROM logs GROUP BY 1"))
def tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.tag_counts(load_logs(spark, sf_dir))


@query(
    "geo_counts",
    with_logs("SELECT country || '|' || city AS key, count(*) AS n FROM logs GROUP BY 1"),
)
def geo_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.geo_counts(load_logs(spark, sf_dir))


@query("error_object_count", with_logs("SELECT count(error_type) AS error_count FROM logs"))
def error_object_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.error_object_count(load_logs(spark, sf_dir))


@query(
    "dimension_counts",
    with_logs(
        """SELECT dimension, key, count(*) AS n FROM (
        SELECT 'level' AS dimension, level AS key FROM logs
        UNION ALL SELECT 'service', service FROM logs
        UNION ALL SELECT 'category', category FROM logs
        UNION ALL SELECT 'error_type', error_type FROM logs)
        WHERE key IS NOT NULL GROUP BY 1, 2"""
    ),
)
def dimension_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.dimension_counts(
        load_logs(spark, sf_dir),
        {
            "level": F.col("level"),
            "service": F.col("service.name"),
            "category": F.col("category"),
            "error_type": F.col("error.type"),
        },
    )


@query(
    "top_per_dimension",
    with_logs(
        """SELECT * FROM (SELECT dimension, key, n,
        row_number() OVER (PARTITION BY dimension ORDER BY n DESC, key) AS rank FROM (
        SELECT dimension, key, count(*) AS n FROM (
        SELECT 'service' AS dimension, service AS key FROM logs
        UNION ALL SELECT 'path', request_path FROM logs) WHERE key IS NOT NULL GROUP BY 1, 2))
        WHERE rank <= CASE dimension WHEN 'service' THEN 3 ELSE 5 END"""
    ),
)
def top_per_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = A.dimension_counts(
        load_logs(spark, sf_dir),
        {"service": F.col("service.name"), "path": F.col("request.path")},
    )
    return A.top_per_dimension(counts, {"service": 3, "path": 5}).withColumn(
        "rank", F.col("rank").cast("bigint")
    )


# -- numbers ---------------------------------------------------------------------


@query(
    "response_time_stats",
    with_logs(
        """SELECT count(response_time_ms) AS count, min(response_time_ms)::DOUBLE AS min,
        max(response_time_ms)::DOUBLE AS max, round(avg(response_time_ms), 6) AS avg,
        sum(response_time_ms)::DOUBLE AS sum FROM logs"""
    ),
)
def response_time_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = A.stats(load_logs(spark, sf_dir), "metrics.response_time_ms")
    return stats.withColumn("avg", F.round("avg", 6))


@query(
    "performance",
    with_logs(
        """SELECT round(avg(response_time_ms), 6) AS avg_response_time,
        max(response_time_ms)::DOUBLE AS max_response_time,
        round(avg(cpu_usage), 6) AS avg_cpu_usage,
        round(avg(memory_mb), 6) AS avg_memory_usage FROM logs"""
    ),
)
def performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = A.performance(load_logs(spark, sf_dir))
    return p.select(*[F.round(c, 6).alias(c) for c in p.columns])


def _summary_sql(column: str) -> str:
    return with_logs(
        f"""SELECT round(min({column})::DECIMAL(38, 10), 2)::DOUBLE AS min,
        round(max({column})::DECIMAL(38, 10), 2)::DOUBLE AS max,
        round(avg({column})::DECIMAL(38, 10), 2)::DOUBLE AS avg FROM logs"""
    )


@query("cpu_summary", _summary_sql("cpu_usage"))
def cpu_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.summary(load_logs(spark, sf_dir), "metrics.cpu_usage")


@query("memory_summary", _summary_sql("memory_mb"))
def memory_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.summary(load_logs(spark, sf_dir), "metrics.memory_mb")


@query(
    "p95_index",
    with_logs(
        """SELECT coalesce(list_sort(list(response_time_ms))[
        least(floor(count(*) * 0.95::DOUBLE), count(*) - 1)::INT + 1], 0)::BIGINT AS p95 FROM logs"""
    ),
)
def p95_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.p95(load_logs(spark, sf_dir), "metrics.response_time_ms")


@query(
    "latency_percentiles",
    with_logs(
        """SELECT p::DOUBLE AS percent, round(v, 6) AS value FROM (
        SELECT unnest([50, 75, 90, 95, 99]) AS p,
        unnest(quantile_cont(response_time_ms::DOUBLE, [0.5, 0.75, 0.9, 0.95, 0.99])) AS v
        FROM logs)"""
    ),
)
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = A.percentiles(load_logs(spark, sf_dir), "metrics.response_time_ms")
    return p.withColumn("value", F.round("value", 6))


@query(
    "latency_percentiles_approx",
    with_logs("""SELECT unnest([50, 75, 90, 95, 99])::DOUBLE AS percent, n, true AS within_bound
        FROM (SELECT count(response_time_ms) AS n FROM logs)"""),
)
def latency_percentiles_approx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each value's rank is within the sketch's bound of a ten-thousandth of the rows."""
    logs = load_logs(spark, sf_dir).select(F.col("metrics.response_time_ms").alias("v"))
    found = A.percentiles(logs, "v", exact=False).collect()
    asked = F.array(
        *[F.struct(F.lit(r["percent"]).alias("percent"), F.lit(r["value"]).alias("value")) for r in found]
    )
    ranks = (
        logs.where("v is not null").select("v", F.inline(asked)).groupBy("percent")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("v") < F.col("value")).alias("below"),
             F.count_if(F.col("v") <= F.col("value")).alias("upto"))
    )
    aim, slack = F.col("n") * F.col("percent") / 100, F.col("n") / 10_000 + 1
    return ranks.select(
        "percent", "n", ((F.col("below") - slack <= aim) & (aim <= F.col("upto") + slack)).alias("within_bound")
    )


@query(
    "env_error_rate",
    with_logs(
        """SELECT environment, count(*) AS total, count(error_type) AS error_count,
        round(count(error_type)::DECIMAL(20, 0) * 100 / count(*), 2)::DOUBLE AS error_rate
        FROM logs GROUP BY 1"""
    ),
)
def env_error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.error_rate_by_environment(load_logs(spark, sf_dir))


# -- time ------------------------------------------------------------------------


def _histogram_ctes(step: str, where: str = "true") -> list[str]:
    millis = {"1h": 3_600_000, "2h": 7_200_000, "1d": 86_400_000, "1w": 604_800_000}[step]
    return [
        f"""counts AS (SELECT (epoch_us(ts) // {millis * 1000}) * {millis} AS b, count(*) AS n
        FROM logs WHERE {where} GROUP BY 1)""",
        f"""series AS (SELECT b, coalesce(n, 0) AS n FROM (
        SELECT unnest(range(min(b), max(b) + 1, {millis})) AS b FROM counts)
        LEFT JOIN counts USING (b))""",
    ]


SPARSE = "critical AND category = 'security'"


def _sparse(logs: DataFrame) -> DataFrame:
    return logs.where(predicates.critical_level() & (F.col("category") == "security"))


def _histogram(name: str, step: str, sparse: bool) -> None:
    sql = with_logs(
        f"SELECT {iso_ms('b')} AS timestamp, n FROM series",
        *_histogram_ctes(step, SPARSE if sparse else "true"),
    )

    @query(name, sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        logs = load_logs(spark, sf_dir)
        return H.time_series(_sparse(logs) if sparse else logs, step)


_histogram("hist_1h", "1h", False)
_histogram("hist_1h_sparse", "1h", True)
_histogram("hist_2h_sparse", "2h", True)
_histogram("hist_2h", "2h", False)
_histogram("hist_1d", "1d", False)
_histogram("hist_1w", "1w", False)


@query(
    "peak_low",
    with_logs(
        f"""SELECT {iso_ms('arg_max(b, (n, -b))')} AS peak_at, max(n) AS peak_n,
        {iso_ms('arg_min(b, (n, b))')} AS low_at, min(n) AS low_n FROM series""",
        *_histogram_ctes("1h"),
    ),
)
def peak_low(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.peak_and_low(H.date_histogram(load_logs(spark, sf_dir), "1h"))


@query(
    "line_labels",
    with_logs(
        f"""SELECT {iso_ms('b')} AS timestamp,
        strftime(epoch_ms(b::BIGINT), '%b %-d, %I %p') AS label, n FROM series""",
        *_histogram_ctes("2h"),
    ),
)
def line_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.labelled(H.date_histogram(load_logs(spark, sf_dir), "2h"))


# -- charts ----------------------------------------------------------------------


def _top_cte(key: str, size: int) -> str:
    return f"""top AS (SELECT {key} AS key, count(*) AS n FROM logs GROUP BY 1
    ORDER BY n DESC, key LIMIT {size})"""


@query(
    "share_of_total",
    with_logs(
        """SELECT key, n, round(n::DECIMAL(20, 0) / sum(n) OVER () * 100, 1)::DOUBLE AS percent,
        floor(n::DOUBLE / sum(n) OVER () * 20 + 0.5)::INT AS bar FROM top""",
        _top_cte("level", 10),
    ),
)
def share_of_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.share_of_total(A.level_distribution(load_logs(spark, sf_dir)))


@query(
    "percent_of_max",
    with_logs(
        """SELECT key, n, round(n::DECIMAL(20, 0) / max(n) OVER () * 100, 1)::DOUBLE AS percent,
        floor(n::DOUBLE / max(n) OVER () * 50 + 0.5)::INT AS bar FROM top""",
        _top_cte("service", 20),
    ),
)
def percent_of_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.percent_of_max(A.top_services(load_logs(spark, sf_dir), 20))


@query(
    "heat_bands",
    with_logs(
        """SELECT key, n, round(100.0::DOUBLE * n / max(n) OVER (), 6) AS normalized,
        CASE WHEN 100.0::DOUBLE * n / max(n) OVER () > 80 THEN '#FF0000'
             WHEN 100.0::DOUBLE * n / max(n) OVER () > 60 THEN '#FF6600'
             WHEN 100.0::DOUBLE * n / max(n) OVER () > 40 THEN '#FFCC00'
             WHEN 100.0::DOUBLE * n / max(n) OVER () > 20 THEN '#99FF00'
             ELSE '#00FF00' END AS band FROM top""",
        _top_cte("service", 20),
    ),
)
def heat_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.heat_bands(A.top_services(load_logs(spark, sf_dir), 20))


# -- dashboard -------------------------------------------------------------------


def _dashboard_sql(days: int, sections: str = "true") -> str:
    step = 3_600_000 if days == 1 else 86_400_000

    def terms(section: str, key: str, size: int, where: str = "true") -> str:
        return f"""(SELECT '{section}' AS section, row_number() OVER (ORDER BY count(*) DESC, {key})
        AS position, {key} AS key, count(*)::DOUBLE AS value FROM seen WHERE {where}
        GROUP BY {key} ORDER BY position LIMIT {size})"""

    def single(section: str, position: int, key: str, value: str) -> str:
        return f"(SELECT '{section}', {position}, '{key}', coalesce({value}, 0)::DOUBLE FROM seen)"

    parts = [
        terms("by_level", "level", 10),
        terms("by_service", "service", 20),
        terms("by_category", "category", 10),
        terms("top_error_services", "service", 10, "critical"),
        terms("geographic", "country", 10),
        single("total_logs", 1, "total", "count(*)"),
        single("critical_logs", 1, "error", "count(*) FILTER (level = 'error')"),
        single("critical_logs", 2, "fatal", "count(*) FILTER (level = 'fatal')"),
        single("critical_logs", 3, "total", "count(*) FILTER (critical)"),
        single("performance", 1, "avg_response_time", "avg(response_time_ms)"),
        single("performance", 2, "max_response_time", "max(response_time_ms)"),
        single("performance", 3, "avg_cpu_usage", "avg(cpu_usage)"),
        single("performance", 4, "avg_memory_usage", "avg(memory_mb)"),
        f"""(SELECT 'time_series', row_number() OVER (ORDER BY b), {iso_ms('b')}, n::DOUBLE
        FROM series)""",
    ]
    return with_logs(
        f"""SELECT section, position, key, round(value, 6) AS value
        FROM ({' UNION ALL '.join(parts)}) WHERE {sections}""",
        f"""seen AS (SELECT * FROM logs WHERE ts >= TIMESTAMP '2024-01-30 12:00:00'
        - INTERVAL {days} DAY AND ts < TIMESTAMP '2024-01-30 12:00:00.001')""",
        f"""counts AS (SELECT (epoch_us(ts) // {step * 1000}) * {step} AS b, count(*) AS n
        FROM seen GROUP BY 1)""",
        f"""series AS (SELECT b, coalesce(n, 0) AS n FROM (
        SELECT unnest(range(min(b), max(b) + 1, {step})) AS b FROM counts)
        LEFT JOIN counts USING (b))""",
    )


AS_OF = "2024-01-30T12:00:00Z"


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(
        "section", F.col("position").cast("bigint").alias("position"), "key",
        F.round("value", 6).alias("value"),
    )


@query("dashboard_long", _dashboard_sql(30))
def dashboard_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(D.fetch_analytics(load_logs(spark, sf_dir), 30, AS_OF))


@query("dashboard_one_day", _dashboard_sql(1))
def dashboard_one_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(D.fetch_analytics(load_logs(spark, sf_dir), 1, AS_OF))


@query("dashboard_nothing", _dashboard_sql(0))
def dashboard_nothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(D.fetch_analytics(load_logs(spark, sf_dir), 0, AS_OF))


@query(
    "chart_data",
    _dashboard_sql(7, "section NOT IN ('total_logs', 'critical_logs', 'performance')"),
)
def chart_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(D.fetch_chart_data(load_logs(spark, sf_dir), 7, AS_OF))


# -- names and labels ------------------------------------------------------------


@query(
    "table_names",
    with_logs(
        """SELECT name, count(*) AS n FROM (SELECT regexp_replace(concat_ws('-', 'logs', service,
        error_type, ts::DATE::VARCHAR), '[^a-zA-Z0-9_-]', '-', 'g') AS name FROM logs) GROUP BY 1"""
    ),
)
def table_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = load_logs(spark, sf_dir).select(
        table_name(
            "logs", F.col("service.name"), F.col("error.type"), F.to_date("timestamp")
        ).alias("name")
    )
    return named.groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query(
    "time_labels",
    with_logs(
        f"""SELECT id, {iso('ts')} AS iso, strftime(ts, '%b %-d, %I %p') AS label,
        strftime(ts, '%Y-%m-%d') AS day FROM logs"""
    ),
)
def time_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_logs(spark, sf_dir).select(
        "id",
        iso_utc("timestamp").alias("iso"),
        chart_label("timestamp").alias("label"),
        F.to_date("timestamp").cast("string").alias("day"),
    )
