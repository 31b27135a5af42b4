import os

import pytest
from conftest import entry
from pyspark.sql import functions as F

from logloom.plans import maintenance as MT
from logloom.sources import manifest, tables
from logloom.streaming import ingest as IN


def day(n, **kw):
    return entry(id=str(n), timestamp=f"2024-01-{n:02d}T10:00:00.000Z", **kw)


def test_manifest_follows_loads_and_clean_ups(spark, lines, tmp_path):
    layout = IN.Layout(str(tmp_path))
    IN.process_batch(lines(day(1), day(2), day(2)), 0, layout)
    IN.process_batch(lines(day(9), entry(timestamp=None)), 1, layout)
    IN.process_batch(lines("{"), 2, layout)  # stores nothing
    IN.process_batch(lines(day(2), day(3)), 1, layout)  # a re-run with other input

    files = IN.read_manifest(spark, layout)
    found = MT.manifest_stats(files).orderBy("name").collect()
    assert [(r["name"][-2:], r["documents"]) for r in found] == [("01", 1), ("02", 3), ("03", 1)]
    assert all(os.path.exists(r["file"].removeprefix("file:")) for r in files.collect())
    assert all("/manifest/" in f for f in MT.manifest_stats(files).inputFiles())
    assert manifest.between(files, "2024-01-02", "2024-01-02 12:00:00").count() == 2

    planned = MT.retention_plan(MT.manifest_stats(files), 8, "2024-01-10").collect()
    plan = spark.createDataFrame([(r["folders"],) for r in planned], "folders array<string>")
    # the first attempt ends before the files are noted, the second finds the folders gone
    assert MT.apply_retention(spark, layout.logs, plan, confirm=True) == MT.Deleted(1, 0)
    again = MT.apply_retention(spark, layout.logs, plan, confirm=True, manifest_root=layout.manifest)
    assert again == MT.Deleted(1, 0)
    assert [r["log_date"].day for r in IN.read_manifest(spark, layout).orderBy("log_date", "batch").collect()] == [2, 2, 3]

    # a batch that runs again after the clean-up writes files of other names
    IN.process_batch(lines(day(1)), 0, layout)
    left = MT.manifest_stats(IN.read_manifest(spark, layout)).orderBy("name").collect()
    assert [(r["name"][-2:], r["documents"]) for r in left] == [("01", 1), ("02", 1), ("03", 1)]


def test_manifest_of_a_whole_table(spark, logs, tmp_path):
    path, root = str(tmp_path / "t"), str(tmp_path / "m")
    tables.write_table(logs(day(1), day(2), entry(timestamp=None)), path)
    for _ in range(2):
        manifest.rebuild(spark, path, root)
    rows = manifest.read(spark, root).orderBy("log_date").collect()
    assert [(r["rows"], r["first"] is None) for r in rows] == [(1, True), (1, False), (1, False)]
    stats = MT.partition_stats(tables.read_table(spark, path))
    columns = ["name", "documents", "files", "size_bytes", "size"]
    assert stats.select(columns).collect() == MT.manifest_stats(manifest.read(spark, root)).select(columns).collect()


def test_a_folder_outside_the_table_is_left_alone(spark, logs, tmp_path):
    path, other = str(tmp_path / "t"), tmp_path / "other"
    other.mkdir()
    tables.write_table(logs(day(1)), path)
    plan = spark.createDataFrame([([f"file:{other}"],)], "folders array<string>")
    assert MT.apply_retention(spark, path, plan, confirm=True) == MT.Deleted(0, 1)
    assert other.exists()
    with pytest.raises(PermissionError):
        MT.apply_retention(spark, path, plan)


def _files_that_may_hold(table, column, value):
    """How many files cannot be skipped for a value by their least and greatest."""
    spans = table.groupBy("_metadata.file_path").agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    return spans.where((F.col("lo") <= F.lit(value)) & (F.col("hi") >= F.lit(value))).count()


def test_clustering_lets_filters_skip_files(spark, logs, tmp_path):
    base = logs(entry()).drop("id", "timestamp", "level", "service")
    n = F.col("n")
    many = spark.range(6000).toDF("n").crossJoin(base).select(
        n.cast("string").alias("id"),
        F.timestamp_seconds(1704067200 + n * 14).alias("timestamp"),
        F.element_at(F.array(*map(F.lit, ["info", "warn", "error", "debug"])), (n * 7 % 4 + 1).cast("int")).alias("level"),
        F.struct(F.concat(F.lit("svc-"), (n * 31 % 8).cast("string")).alias("name")).alias("service"),
        *base.columns,
    )
    plain, curved = str(tmp_path / "p"), str(tmp_path / "c")
    tables.write_table(many, str(tmp_path / "t"))
    MT.compact(spark, str(tmp_path / "t"), plain, max_records=200)
    MT.compact(spark, str(tmp_path / "t"), curved, cluster=MT.CLUSTER, max_records=200)
    a, b = tables.read_table(spark, plain), tables.read_table(spark, curved)
    assert a.select("id", "level", "service.name").exceptAll(b.select("id", "level", "service.name")).isEmpty()
    assert a.count() == b.count() == 6000
    files = b.select("_metadata.file_path").distinct().count()
    for column, value in (("level", "error"), ("service.name", "svc-3")):
        assert _files_that_may_hold(b, column, value) < 0.7 * _files_that_may_hold(a, column, value)
    assert _files_that_may_hold(b, "timestamp", "2024-01-01 12:00:00") < 0.7 * files


def test_clustering_by_odd_columns(spark, logs, tmp_path):
    path = str(tmp_path / "t")
    tables.write_table(logs(day(1), day(1, level=None), day(1, metrics={"cpu_usage": None})), path)
    MT.compact(spark, path, cluster=("error.code", "metrics.cpu_usage", "level"))  # a column without values, missing ones
    assert tables.read_table(spark, path).count() == 3
    with pytest.raises(ValueError):
        MT.compact(spark, path, cluster=("tags",))


def test_place_on_the_curve_is_worked_out_without_lambdas(spark, logs):
    docs = [entry(id=str(i), level=["info", "warn", "error"][i % 3], service={"name": f"svc-{i % 7}"}) for i in range(50)]
    docs += [entry(id="none", level=None, metrics={"cpu_usage": None})]
    table = logs(*docs)
    for cluster in (MT.CLUSTER, ("metrics.cpu_usage", "level")):
        placed = MT.on_curve(table, cluster, "place")
        assert "lambda" not in placed._jdf.queryExecution().optimizedPlan().toString()
        assert placed.columns == [*table.columns, "place"]
        # the rank of a value is the number of quantiles up to it, and its bits take turns with those of the others
        ordinals = [MT._ordinal(table, c) for c in cluster]
        parts = [i / 64 for i in range(1, 64)]
        found = table.agg(*[F.percentile_approx(o, parts) for o in ordinals]).head()
        for row in placed.select("place", *[o.alias(f"o{i}") for i, o in enumerate(ordinals)]).collect():
            want = 0
            for i, bounds in enumerate(found):
                value = row[f"o{i}"]
                rank = 0 if value is None else sum(b <= value for b in bounds or [])
                want |= sum((rank >> bit & 1) << (bit * len(cluster) + len(cluster) - 1 - i) for bit in range(6))
            assert row["place"] == want
