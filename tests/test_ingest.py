import json
import os

import pytest
from conftest import entry
from pyspark.sql import functions as F

from logloom.plans import maintenance as MT
from logloom.sources import ndjson, synthetic, tables, validation
from logloom.streaming import ingest as IN
from logloom.streaming import progress as PR


def check(lines, *docs, **kw):
    return validation.validate(lines(*docs), **kw)


def reasons(df):
    return [(x["field"], x["type"]) for r in df.collect() for x in r["reject_reasons"]]


def test_clean_record_is_accepted(lines):
    row = validation.accepted(check(lines, entry())).head()
    assert row["metrics"]["response_time_ms"] == 150
    assert row["geo"]["location"].asDict() == {"lat": 47.6062, "lon": -122.3321}
    assert row["error"] is None and row["tags"] == ["api-gateway"]


@pytest.mark.parametrize(
    "point, lat, lon",
    [
        ("POINT (-71.34 41.12)", 41.12, -71.34),
        ("  point z(1e1 -.5 7) ", -0.5, 10.0),
        ("41.12,-71.34,5", 41.12, -71.34),
        ({"type": "point", "coordinates": [-71.34, 41.12]}, 41.12, -71.34),
        ([-71.34, 41.12], 41.12, -71.34),
        ("s", 0.0, 0.0),
        ("7zzzzzzzzzzz", -180.0 / 2**30, -360.0 / 2**30),
        ({"geohash": "u4pruydqqvjz"}, 57.64911, 10.40744),
        ("u4pruydqqvjzzzzz", 57.64911, 10.40744),
    ],
)
def test_forms_of_a_point(lines, point, lat, lon):
    found = validation.accepted(check(lines, entry(geo={"location": point}))).head()["geo"]["location"]
    assert found["lat"] == pytest.approx(lat, abs=1e-5) and found["lon"] == pytest.approx(lon, abs=1e-5)


@pytest.mark.parametrize(
    "point",
    ["", "POINT EMPTY", "POINT (200 1)", "POINT (1 2) x", "POINT (1d 2)", "LINESTRING (1 2, 3 4)", "1,2,3,4",
     "1,2,x", "u4a", "U4", 12, True, {"type": "Line", "coordinates": [1, 2]}, {"geohash": "i"}, {}, []],
)
def test_points_that_are_refused(lines, point):
    assert reasons(check(lines, entry(geo={"location": point}))) == [("geo.location", "mapper_parsing_exception")]


def test_numbers_are_coerced(lines):
    doc = entry(
        metrics={"memory_mb": "12", "response_time_ms": 12.9, "db_query_time_ms": -3.7},
        business={"amount": "10.005", "currency": "USD"},
    )
    row = validation.accepted(check(lines, doc)).head()
    assert [row["metrics"][k] for k in ("memory_mb", "response_time_ms", "db_query_time_ms")] == [
        12, 12, -3
    ]
    assert float(row["business"]["amount"]) in (10.0, 10.01)


@pytest.mark.parametrize(
    "override, field",
    [
        ({"metrics": {"memory_mb": "x"}}, "metrics.memory_mb"),
        ({"metrics": {"memory_mb": ""}}, "metrics.memory_mb"),
        ({"metrics": {"memory_mb": 3_000_000_000}}, "metrics.memory_mb"),
        ({"metrics": {"cpu_usage": "NaN"}}, "metrics.cpu_usage"),
        ({"timestamp": "soon"}, "timestamp"),
        ({"request": {"ip": "300.1.1.1"}}, "request.ip"),
        ({"geo": {"location": {"lat": 91, "lon": 0}}}, "geo.location"),
        ({"geo": {"location": "north"}}, "geo.location"),
        ({"service": "api"}, "service"),
        ({"level": {"name": "info"}}, "level"),
        ({"business": {"amount": "much"}}, "business.amount"),
    ],
)
def test_faults(lines, override, field):
    doc = entry()
    for key, value in override.items():
        doc[key] = {**doc.get(key, {}), **value} if isinstance(value, dict) and key != "level" else value
    assert reasons(check(lines, doc)) == [(field, "mapper_parsing_exception")]


def test_points_in_three_forms(lines):
    docs = [
        entry(geo={"location": x}) for x in ({"lat": 1, "lon": 2}, "1,2", [2, 1])
    ]
    rows = validation.accepted(check(lines, *docs)).select("geo.location").collect()
    assert [(r["location"]["lat"], r["location"]["lon"]) for r in rows] == [(1.0, 2.0)] * 3


def test_text_that_looks_like_an_object(lines):
    doc = entry(message='{"a": 1}', level='{"x"}')
    assert validation.accepted(check(lines, doc)).head()["message"] == '{"a": 1}'


def test_malformed_lines_carry_themselves(lines):
    bad = validation.rejects(check(lines, "{oops", "[1]", entry(timestamp="x", id="z"))).collect()
    assert sorted((r["error_type"], r["details"]["document_id"]) for r in bad if r["details"]["document_id"]) == [
        ("insertion", "z")
    ]
    assert sorted(r["error_type"] for r in bad) == ["insertion", "serialization", "serialization"]
    assert {"{oops", "[1]"} <= {r["details"]["document"] for r in bad}


def test_missing_timestamp_and_empty_error(lines):
    doc = entry(timestamp=None, error={})
    row = validation.accepted(check(lines, doc)).head()
    assert row["timestamp"] is None and row["error"] is not None
    assert reasons(check(lines, doc, required=("timestamp",)))[0][0] == "timestamp"


def test_unknown_fields_are_dropped(lines):
    assert "extra" not in check(lines, entry(extra=1)).columns


def test_bulk_lines(logs):
    rows = logs(entry(id="log-1"), entry(id="log-2"))
    out = ndjson.bulk_lines(rows, "logs-test").orderBy("id", "ordinal").collect()
    assert len(out) == 4
    assert json.loads(out[0]["line"]) == {"index": {"_index": "logs-test"}}
    assert json.loads(out[1]["line"])["id"] == "log-1"
    assert json.loads(out[2]["line"]) == {"index": {"_index": "logs-test"}}
    # the two lines of a record follow each other as written
    written = [r["line"] for r in ndjson.bulk_lines(rows, "logs-test").collect()]
    assert [('"index"' in x) for x in written] == [True, False, True, False]


def test_ndjson_leaves_out_absent_fields(spark, tmp_path, logs):
    ndjson.write_ndjson(logs(entry()), str(tmp_path / "out"))
    text = ndjson.read_lines(spark, str(tmp_path / "out")).head()["value"]
    doc = json.loads(text)
    assert "error" not in doc and doc["timestamp"] == "2024-01-01T10:00:00.000Z"


def days(logs, *numbers):
    return logs(*[entry(id=f"d{d}", timestamp=f"2024-01-{d:02d}T10:00:00Z") for d in numbers])


def test_append_and_force(spark, tmp_path, logs):
    path = str(tmp_path / "t")
    tables.write_table(days(logs, 1, 2), path)
    tables.write_table(days(logs, 2, 3), path)
    assert tables.read_table(spark, path).count() == 4
    tables.write_table(days(logs, 2), path, force=True)
    counts = tables.read_table(spark, path).groupBy("log_date").count().collect()
    assert {str(r["log_date"])[-2:]: r["count"] for r in counts} == {"01": 1, "02": 1, "03": 1}


def test_scope_prunes(spark, tmp_path, logs):
    path = str(tmp_path / "t")
    tables.write_table(days(logs, 1, 2, 11), path)
    tables.write_table(days(logs, 1), path, "other")
    table = tables.read_table(spark, path)
    found = tables.scope(table, pattern="logs-2024-01-0*")
    assert found.count() == 2
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "RLIKE" in plan.split("PartitionFilters: [")[1].split("PushedFilters")[0]
    assert tables.scope(table, day="2024-01-01").count() == 1
    assert tables.scope(table, names=["other-2024-01-01"]).count() == 1


def test_retention(spark, tmp_path, logs):
    path = str(tmp_path / "t")
    rows = days(logs, 1, 2, 3, 4).unionByName(logs(entry(id="x", timestamp=None)))
    tables.write_table(rows, path)
    stats = MT.partition_stats(tables.read_table(spark, path))
    assert MT.stats_summary(stats).head()["documents"] == 5
    plan = MT.retention_plan(stats, 2, "2024-01-05")
    # strictly before the third; the partition without a day stays
    assert sorted(r["name"] for r in plan.collect()) == ["logs-2024-01-01", "logs-2024-01-02"]
    with pytest.raises(PermissionError):
        MT.apply_retention(spark, path, plan)
    assert MT.apply_retention(spark, path, plan, confirm=True) == MT.Deleted(2, 0)
    assert tables.read_table(spark, path).count() == 3
    named = MT.retention_plan(
        MT.partition_stats(tables.read_table(spark, path)), 99, "2024-01-05",
        names=["logs-2024-01-04", "logs-unknown"],
    )
    assert MT.plan_totals(named).head()["documents"] == 2
    assert MT.apply_retention(spark, path, named, confirm=True).deleted == 2
    assert tables.read_table(spark, path).count() == 1


def test_compaction_keeps_rows(spark, tmp_path, logs):
    path = str(tmp_path / "t")
    for _ in range(3):
        tables.write_table(days(logs, 1, 2), path)
    before = MT.partition_stats(tables.read_table(spark, path)).collect()
    MT.compact(spark, path)
    spark.catalog.refreshByPath(path)
    after = MT.partition_stats(tables.read_table(spark, path)).collect()
    assert sum(r["files"] for r in before) == 6 and sum(r["files"] for r in after) == 2
    assert [r["documents"] for r in after] == [3, 3]


def test_batch_summary(spark):
    batches = spark.createDataFrame(
        [(0, 2, 1, 1, 100), (1, 2, 2, 0, 300)],
        "batch_id bigint, rows bigint, inserted bigint, failed bigint, duration_ms bigint",
    )
    row = PR.summary(batches).head()
    assert (row["batches"], row["total_inserted"], row["failed_documents"]) == (2, 3, 1)
    assert (row["average_batch_size"], row["max_batch_duration_ms"]) == (1.5, 300)
    assert (row["average_rate_per_second"], row["inserted_rate_per_second"]) == (10.0, 7.5)
    steps = [(r["inserted"], r["total"]) for r in PR.progress(batches, 4).orderBy("batch_id").collect()]
    assert steps == [(1, 1), (2, 3)]
    nothing = PR.summary(batches.where("false")).head()
    assert (nothing["batches"], nothing["average_batch_size"]) == (0, 0.0)


def test_stream_ingest_and_repeat(spark, tmp_path, lines):
    source = str(tmp_path / "in")
    docs = [entry(id="log-1"), entry(id="log-2", metrics={"memory_mb": "x"}), "{oops"]
    lines(*docs).coalesce(1).write.text(source)
    layout = IN.Layout(str(tmp_path / "out"))
    IN.ingest(spark, source, layout).awaitTermination()
    book = IN.read_ledger(spark, layout).collect()
    assert [(r["rows"], r["inserted"], r["failed"]) for r in book] == [(3, 1, 2)]
    # a batch that runs again leaves the same rows
    IN.process_batch(lines(*docs), 0, layout)
    assert tables.read_table(spark, layout.logs).count() == 1
    assert IN.read_rejects(spark, layout).count() == 2
    assert IN.read_ledger(spark, layout).count() == 1
    # new files make a new batch
    lines(entry(id="log-3", timestamp="2024-01-02T00:00:00Z")).write.mode("append").text(source)
    IN.ingest(spark, source, layout).awaitTermination()
    assert tables.read_table(spark, layout.logs).count() == 2
    total = IN.read_metrics(spark, layout).where("dimension = 'total'").head()
    assert total["n"] == 2
    merged = str(tmp_path / "compact")
    MT.compact(spark, layout.logs, merged)
    assert spark.read.parquet(merged).count() == 2


def test_stream_drops_repeats(spark, tmp_path, logs):
    rows = logs(entry(id="a"), entry(id="a"), entry(id="b"))
    rows.select("id", "timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id string, timestamp timestamp").parquet(str(tmp_path / "in"))
    (
        IN.drop_repeats(stream)
        .writeStream.format("parquet")
        .option("checkpointLocation", str(tmp_path / "cp"))
        .trigger(availableNow=True)
        .start(str(tmp_path / "out"))
        .awaitTermination()
    )
    kept = spark.read.parquet(str(tmp_path / "out")).agg(F.sort_array(F.collect_list("id"))).head()[0]
    assert kept == ["a", "b"]


def test_rerun_replaces_the_whole_batch(spark, tmp_path, lines):
    layout = IN.Layout(str(tmp_path / "out"))
    IN.process_batch(lines(entry(id="a"), "{oops"), 7, layout)
    IN.process_batch(lines(entry(id="x")), 8, layout)
    IN.process_batch(lines(entry(id="b", timestamp="2024-01-02T00:00:00Z")), 7, layout)
    table = tables.read_table(spark, layout.logs).select("id", "batch").collect()
    assert sorted((r["id"], r["batch"]) for r in table) == [("b", 7), ("x", 8)]
    assert {r["batch_id"]: (r["rows"], r["inserted"], r["failed"]) for r in IN.read_ledger(spark, layout).collect()} == {
        7: (1, 1, 0), 8: (1, 1, 0)
    }
    assert not [f for _, _, names in os.walk(layout.rejects) for f in names if f.startswith("part-")] or (
        spark.read.text(layout.rejects).count() == 0
    )
    assert IN.read_metrics(spark, layout).where("dimension = 'total'").head()["n"] == 2


def test_corrected_document_is_stored(spark, tmp_path, lines):
    layout = IN.Layout(str(tmp_path / "out"))
    IN.process_batch(lines(entry(id="x", metrics={"memory_mb": "n/a"}), entry(id="y"), entry(id="y")), 1, layout, remember_ids="1 hour")
    IN.process_batch(lines(entry(id="x"), entry(id="y"), entry(id=None), entry(id=None)), 2, layout, remember_ids="1 hour")
    # another day is another document; without a day, ids are told apart as well
    later = [entry(id="x", timestamp="2024-01-02T00:00:00Z"), entry(id="z", timestamp=None)]
    IN.process_batch(lines(*later), 3, layout, remember_ids=IN.ALWAYS)
    IN.process_batch(lines(*later), 4, layout, remember_ids=IN.ALWAYS)
    stored = tables.read_table(spark, layout.logs).select("id", "batch").collect()
    assert sorted((str(r["id"]), r["batch"]) for r in stored) == [("None", 2), ("None", 2), ("x", 2), ("x", 3), ("y", 1), ("z", 3)]
    assert [r["inserted"] for r in IN.read_ledger(spark, layout).orderBy("batch_id").collect()] == [1, 3, 2, 0]
    # the same batch again does not find its own ids
    IN.process_batch(lines(*later), 3, layout, remember_ids=IN.ALWAYS)
    assert tables.read_table(spark, layout.logs).where("batch = 3").count() == 2


def test_only_recent_batches_are_remembered(spark, tmp_path, lines):
    layout = IN.Layout(str(tmp_path / "out"))
    for batch in (1, 2):
        IN.process_batch(lines(entry(id="x")), batch, layout, remember_ids="0 seconds")
    assert tables.read_table(spark, layout.logs).count() == 2


def test_generated_stream(spark, tmp_path):
    layout = IN.Layout(str(tmp_path / "out"))
    for _ in range(2):
        IN.generate(spark, layout, 25, 10, "2024-03-01", partitions=2)
    assert [(r["batch_id"], r["rows"]) for r in IN.read_ledger(spark, layout).orderBy("batch_id").collect()] == [(0, 10), (1, 10), (2, 5)]
    rows = tables.read_table(spark, layout.logs)
    assert rows.count() == 25 == rows.select("id").distinct().count()
    assert [str(r["log_date"]) for r in rows.select("log_date").distinct().collect()] == ["2024-03-01"]
    # the records are those that the table form makes of the same numbers
    table = synthetic.finish(synthetic.synthesize(spark.range(25).withColumnRenamed("id", "seq"), "2024-03-01"))
    assert {r["id"] for r in rows.collect()} == {r["id"] for r in table.collect()}
