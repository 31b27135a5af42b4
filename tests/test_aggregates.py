import math

from conftest import entry
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logloom.operators import aggregates as A
from logloom.operators import histogram as H
from logloom.operators import metrics as M
from logloom.operators import reports as R

ERROR = {
    "type": "TimeoutException", "message": "Connection timeout", "stack_trace": "stack",
    "code": "TO_1001",
}


def numbers(spark, values):
    return spark.createDataFrame([(v,) for v in values], "v int")


def test_p95_follows_the_index_rule(spark):
    assert A.p95(numbers(spark, range(1, 21)), "v").head()["p95"] == 20
    assert A.p95(numbers(spark, []), "v").head()["p95"] == 0


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.integers(-20_000, 20_000), min_size=1, max_size=60))
def test_p95_equals_the_sorted_list(spark, values):
    expected = sorted(values)[min(math.floor(len(values) * 0.95), len(values) - 1)]
    assert A.p95(numbers(spark, values), "v").head()["p95"] == expected


def test_terms_order_and_nulls(logs):
    rows = logs(
        entry(level="warn"), entry(level="info"), entry(level="error"), entry(level="error"),
        entry(level=None),
    )
    got = [(r["key"], r["n"]) for r in A.terms(rows, "level", 2).collect()]
    assert got == [("error", 2), ("info", 1)]


def test_unknown_values_are_counted_apart(logs):
    rows = logs(entry(level="info"), entry(level="notice"))
    got = {r["key"]: r["n"] for r in A.zero_filled(rows, "level", ["info", "warn"]).collect()}
    assert got == {"info": 1, "warn": 0, "other": 1}


def test_error_rate_counts_existing_errors(logs):
    rows = logs(entry(error=ERROR), entry(error={}), entry(level="error"))
    row = A.error_rate_by_environment(rows).head()
    assert (row["total"], row["error_count"], row["error_rate"]) == (3, 1, 33.33)
    assert A.error_object_count(rows).head()["error_count"] == 2
    assert A.critical_counts(rows).head().asDict() == {"error": 1, "fatal": 0, "total": 1}


def test_statistics_of_nothing_are_zero(logs):
    none = logs(entry()).where("false")
    assert A.stats(none, "metrics.response_time_ms").head().asDict() == {
        "count": 0, "min": 0.0, "max": 0.0, "avg": 0.0, "sum": 0.0
    }
    assert H.date_histogram(none, "1h").count() == 0
    snapshot = M.snapshot(M.merge(M.partials(none))).head()
    assert snapshot["total_generated"] == 0 and snapshot["response_time_p95"] == 0
    assert snapshot["level_counts"]["info"] == 0


def test_histogram_fills_gaps(logs):
    rows = logs(
        entry(timestamp="2024-01-01T10:59:59.999Z"), entry(timestamp="2024-01-01T13:00:00Z"),
        entry(timestamp=None),
    )
    got = [(str(r["bucket"]), r["n"]) for r in H.date_histogram(rows, "1h").orderBy("bucket").collect()]
    assert [n for _, n in got] == [1, 0, 0, 1]
    assert got[0][0].endswith("10:00:00")
    assert H.date_histogram(rows, "1h", gaps=False).count() == 2


def test_histogram_with_many_empty_buckets(logs):
    rows = logs(
        entry(timestamp="2024-01-01T00:00:00Z"), entry(timestamp="2024-01-01T08:20:00Z")
    )
    filled = H.date_histogram(rows, "1s")
    assert filled.count() == 30_001
    assert filled.select("bucket").distinct().count() == 30_001
    assert filled.agg(F.sum("n")).head()[0] == 2


def test_peak_and_low_take_the_first(logs):
    hours = [10, 10, 11, 12, 12, 13]
    rows = logs(*[entry(timestamp=f"2024-01-01T{h}:00:00Z") for h in hours])
    row = H.peak_and_low(H.date_histogram(rows, "1h")).head()
    assert (row["peak_at"][11:13], row["peak_n"]) == ("10", 2)
    assert (row["low_at"][11:13], row["low_n"]) == ("11", 1)


def test_chart_tables(spark):
    buckets = spark.createDataFrame([("a", 200), ("b", 100), ("c", 1)], "key string, n bigint")
    bars = {r["key"]: (r["percent"], r["bar"]) for r in R.percent_of_max(buckets).collect()}
    assert bars == {"a": (100.0, 50), "b": (50.0, 25), "c": (0.5, 0)}
    pie = {r["key"]: r["percent"] for r in R.share_of_total(buckets).collect()}
    assert pie == {"a": 66.4, "b": 33.2, "c": 0.3}
    heat = {r["key"]: r["band"] for r in R.heat_bands(buckets).collect()}
    assert heat == {"a": "#FF0000", "b": "#FFCC00", "c": "#00FF00"}


def three(logs):
    def m(cpu, memory, response, db):
        return {
            "cpu_usage": cpu, "memory_mb": memory, "response_time_ms": response,
            "db_query_time_ms": db,
        }

    return logs(
        entry(metrics=m(10, 512, 200, 20), tags=["api", "search-demo"]),
        entry(level="error", metrics=m(70, 1024, 600, 80), error=ERROR),
        entry(level="warn", metrics=m(40, 768, 400, 50), service={"environment": "staging"}),
    )


def test_snapshot(logs):
    merged = M.merge(M.partials(three(logs)))
    row = M.snapshot(merged).head()
    assert (row["total_generated"], row["error_count"]) == (3, 1)
    assert row["level_counts"] == {
        "trace": 0, "debug": 0, "info": 1, "warn": 1, "error": 1, "fatal": 0
    }
    assert row["environment_counts"] == {"production": 2, "staging": 1, "development": 0}
    assert (row["response_time_avg"], row["response_time_min"], row["response_time_max"]) == (
        400.0, 200.0, 600.0
    )
    assert row["response_time_p95"] == 600
    tags = {r["key"]: r["n"] for r in M.counts(merged).where("dimension = 'tag'").collect()}
    assert tags == {"api": 1, "search-demo": 1, "api-gateway": 2}


def test_snapshot_lists_every_key(logs):
    names = [f"n{i}" for i in range(1200)]
    rows = [entry(service={"name": v}, geo={"city": v}, tags=[v, f"{v}-b"]) for v in names]
    row = M.snapshot(M.merge(M.partials(logs(*rows, rows[7])))).head()
    once = dict.fromkeys(names, 1) | {"n7": 2}
    assert row["service_counts"] == once
    assert row["geo_counts"] == {f"US|{v}": n for v, n in once.items()}
    assert row["tag_counts"] == once | {f"{v}-b": n for v, n in once.items()}


def test_partials_merge_in_any_split(logs):
    rows = three(logs)
    parts = [M.partials(rows.where(c)) for c in ("level = 'info'", "level <> 'info'")]
    split = M.merge(parts[0].unionByName(parts[1]))
    whole = M.merge(M.partials(rows))
    assert M.numbers(split).collect() == M.numbers(whole).collect()
    assert sorted(M.counts(split).collect()) == sorted(M.counts(whole).collect())


def test_count_map(spark):
    buckets = spark.createDataFrame([("a", 2), ("b", 1)], "key string, n bigint")
    assert M.count_map(buckets).head()["counts"] == {"a": 2, "b": 1}
