import pytest
from conftest import entry
from pyspark.sql import functions as F

from logloom.operators import filters as FI
from logloom.operators import paging as P
from logloom.schema import LOG_SCHEMA
from logloom.sources.events import load_logs

ERROR = {"type": "TimeoutException", "message": "Connection timeout", "code": "TO_1001"}


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


def test_view_has_the_schema(spark, sf_dir):
    def shape(t):
        return t.simpleString()

    assert shape(load_logs(spark, sf_dir).schema) == shape(LOG_SCHEMA)


def test_zero_bound_is_no_bound(logs):
    rows = logs(entry(id="a", metrics={"response_time_ms": 5}), entry(id="b"))
    assert ids(FI.apply_filters(rows, FI.LogFilters(min_response_time=0))) == ["a", "b"]
    assert ids(FI.apply_filters(rows, FI.LogFilters(max_response_time=0))) == ["a", "b"]
    assert ids(FI.apply_filters(rows, FI.LogFilters(max_response_time=5))) == ["a"]


def test_error_exists_needs_a_searchable_part(logs):
    rows = logs(
        entry(id="full", error=ERROR),
        entry(id="empty", error={}),
        entry(id="stack", error={"stack_trace": "x"}),
        entry(id="none"),
    )
    assert ids(FI.apply_filters(rows, FI.LogFilters(has_error=True))) == ["full"]
    assert ids(FI.apply_filters(rows, FI.LogFilters(has_error=False))) == ["empty", "none", "stack"]
    assert len(ids(FI.apply_filters(rows, FI.LogFilters()))) == 4


def test_time_range_is_inclusive_and_skips_missing(logs):
    rows = logs(
        entry(id="a", timestamp="2024-01-01T00:00:00.000Z"),
        entry(id="b", timestamp="2024-01-02T23:59:59.999Z"),
        entry(id="c", timestamp="2024-01-03T00:00:00.000Z"),
        entry(id="d", timestamp=None),
    )
    assert ids(FI.time_range(rows, "2024-01-01", "2024-01-02")) == ["a", "b"]
    assert ids(FI.time_range(rows, None, "2024-01-03T00:00:00.000Z")) == ["a", "b", "c"]
    assert ids(FI.missing_timestamp(rows)) == ["d"]


def test_time_range_prunes_partitions(spark, tmp_path, logs):
    from logloom.sources import tables

    rows = logs(*[entry(id=str(d), timestamp=f"2024-01-0{d}T10:00:00Z") for d in range(1, 8)])
    tables.write_table(rows, str(tmp_path / "t"))
    found = FI.time_range(tables.read_table(spark, str(tmp_path / "t")), "2024-01-03", "2024-01-04")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "log_date" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert ids(found) == ["3", "4"]


def test_nested_filter_and_projection_reach_the_scan(spark, tmp_path, logs):
    logs(entry()).write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    found = FI.project(FI.slow_requests(table, 100), ["id", "service.name"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(metrics.response_time_ms,100)" in plan
    schema = plan.split("ReadSchema:")[1]
    assert "message" not in schema and "region" not in schema


def test_project_keeps_absent_objects_absent(logs):
    rows = logs(entry(id="a", error=ERROR), entry(id="b"))
    out = {r["id"]: r for r in FI.project(rows, ["id", "error.type", "error.code"]).collect()}
    assert out["a"]["error"].asDict() == {"type": "TimeoutException", "code": "TO_1001"}
    assert out["b"]["error"] is None


def test_pages_join_to_the_whole_order(spark, sf_dir):
    logs = load_logs(spark, sf_dir)
    whole = [r["id"] for r in logs.orderBy(*P.newest_first()).limit(95).collect()]
    paged = []
    for offset in range(0, 95, 19):
        paged += [r["id"] for r in P.page_rows(logs, 19, offset).collect()]
    assert paged == whole


def test_page_info(logs):
    rows = logs(*[entry(id=str(i)) for i in range(5)])
    assert P.page_info(rows, 2, 0).head().asDict() == {
        "total": 5, "has_next_page": True, "has_previous_page": False
    }
    assert P.page_info(rows, 2, 3).head().asDict() == {
        "total": 5, "has_next_page": False, "has_previous_page": True
    }


def test_missing_timestamps_come_last(logs):
    rows = logs(entry(id="a", timestamp=None), entry(id="b"))
    assert [r["id"] for r in P.page_rows(rows).collect()] == ["b", "a"]


def test_pages_far_on(logs):
    assert P.page_rows(logs(entry()), 20, 9_990).count() == 0
    with pytest.raises(ValueError):
        P.page_rows(logs(entry()), 20, -1)


def test_pages_use_top_k(spark, sf_dir):
    plan = P.page_rows(load_logs(spark, sf_dir), 20, 40)._jdf.queryExecution().executedPlan()
    assert "TakeOrderedAndProject(limit=60, offset=40" in plan.toString().replace(" ", " ")


def test_lookup(logs):
    rows = logs(entry(id="a"), entry(id="b"))
    assert ids(FI.lookup(rows, "b")) == ["b"]
    assert FI.lookup(rows, "zzz").count() == 0
    assert rows.where(F.col("id") == "a").count() == 1
