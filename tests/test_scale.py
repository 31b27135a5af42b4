"""What must hold of plans and of inputs that the contract tables do not have."""

import pytest
from conftest import entry
from pyspark.sql import functions as F

from logloom.operators import aggregates as A
from logloom.operators import metrics as M
from logloom.operators import search as S
from logloom.plans import dashboard as D
from logloom.plans import maintenance as MT
from logloom.sources import tables, validation
from logloom.sources.events import load_documents, load_logs
from logloom.streaming import ingest as IN


def final_plan(df):
    """The plan that ran, with those of its subqueries."""
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    return "".join(p.split("== Initial Plan ==")[0] for p in text.split("== Final Plan ==")[1:])


@pytest.fixture
def table(spark, tmp_path):
    load_logs(spark, "/root/testdata/sf0.001").write.parquet(str(tmp_path / "logs"))
    return spark.read.parquet(str(tmp_path / "logs"))


def test_dashboard_reads_once(table):
    plan = final_plan(D.dashboard(table, "1h"))
    assert plan.count("FileScan") == 1
    assert "ReusedExchange" in plan


def test_snapshot_reads_once(table):
    plan = final_plan(M.snapshot(M.merge(M.partials(table))))
    assert "ReusedExchange" in plan
    assert plan.count("FileScan") <= 1


def test_dashboard_of_distant_records(spark, logs):
    rows = logs(*[entry(id=str(y), timestamp=f"{y}-01-01T00:00:00Z") for y in (1970, 2019)])
    series = D.dashboard(rows, "1h").where("section = 'time_series'")
    found = series.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("v"), F.max("position").alias("p")).head()
    hours = (2019 - 1970) * 8760 + 12 * 24 + 1
    assert (found["n"], found["v"], found["p"]) == (hours, 2.0, hours)
    # the finest interval has too many buckets to list here, but neither an array nor a window of them
    plan = D.dashboard(rows, "500ms")._jdf.queryExecution().executedPlan().toString()
    windows = [x for x in plan.splitlines() if "Window" in x and "windowspecdefinition" in x]
    # the one window cuts the terms; there every bucket is a group of its own
    assert len(windows) == 1 and "row_number() windowspecdefinition(section#" in windows[0] and "_w0#" in windows[0]
    assert "lead(" not in plan


def test_fuzzy_search_gathers_no_list(spark, sf_dir):
    field = S.TextField("text", stem=False)
    plan = S.multi_match(load_documents(spark, sf_dir), "thatin", [field])
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in text and "Window" not in text


def test_percentiles_of_fractions_without_one_buffer(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000 / 8.0 - 20).alias("v"), F.lit(None).cast("double").alias("nothing"))
    got = {r["percent"]: r["value"] for r in A.percentiles(df, "v", [0, 50, 99, 100]).collect()}
    want = df.select(F.percentile("v", F.array(*[F.lit(p) for p in (0.0, 0.5, 0.99, 1.0)])).alias("p")).head()["p"]
    assert [round(got[p], 9) for p in (0.0, 50.0, 99.0, 100.0)] == [round(x, 9) for x in want]
    assert {r["value"] for r in A.percentiles(df.select(F.lit(5).alias("v")), "v").collect()} == {5.0}
    assert A.percentiles(df, "nothing").count() == 0


@pytest.mark.parametrize(
    "override, field",
    [
        ({"message": {"a": 1}}, "message"),
        ({"error": {"message": {"x": 1}}}, "error.message"),
        ({"tags": {"x": 1}}, "tags"),
        ({"tags": ["a", {"x": 1}]}, "tags"),
        ({"metrics": {"memory_mb": 2147483648}}, "metrics.memory_mb"),
        ({"metrics": {"memory_mb": "-2147483649"}}, "metrics.memory_mb"),
    ],
)
def test_objects_and_limits_are_refused(lines, override, field):
    checked = validation.validate(lines({**entry(), **override}))
    assert [x["field"] for r in checked.collect() for x in r["reject_reasons"]] == [field]


def test_limits_and_mapped_addresses_are_accepted(lines):
    docs = [entry(metrics={"memory_mb": n}) for n in (-2147483648, 2147483647.9, "-2147483648.5")]
    docs += [{**entry(), "request": {"ip": ip}} for ip in ("::ffff:1.2.3.4", "1:2:3:4:5:6:1.2.3.4", "::1.2.3.4")]
    rows = validation.accepted(validation.validate(lines(*docs))).collect()
    assert sorted(r["metrics"]["memory_mb"] for r in rows)[:2] == [-2147483648, -2147483648] and len(rows) == 6
    bad = [{**entry(), "request": {"ip": ip}} for ip in ("::ffff:1.2.3.400", "1:2:3:4:5:6:7:1.2.3.4", "::ffff:1.2.3")]
    assert validation.accepted(validation.validate(lines(*bad))).count() == 0


def test_retention_stays_inside_the_table(spark, tmp_path, logs):
    path, outside = str(tmp_path / "t"), tmp_path / "victim"
    rows = logs(entry(id="1", timestamp="2024-01-01T00:00:00Z"))
    tables.write_table(rows, path, "x/../../victim")
    tables.write_table(rows, path, "007")
    tables.write_table(rows, str(outside), "keep")
    table = tables.read_table(spark, path)
    assert {r["family"] for r in table.select("family").collect()} == {"x/../../victim", "007"}
    stats = MT.partition_stats(table)
    foreign = MT.partition_stats(tables.read_table(spark, str(outside)))
    done = MT.apply_retention(spark, path, stats.unionByName(foreign), confirm=True)
    assert (done.deleted, done.failed) == (2, 1)
    assert tables.read_table(spark, str(outside)).count() == 1


def test_ledger_counts_what_prepare_leaves(spark, tmp_path, lines):
    docs = [entry(id=str(i), level="info" if i % 2 else "debug") for i in range(10)]
    layout = IN.Layout(str(tmp_path / "run"))
    IN.process_batch(lines(*docs, "{broken"), 3, layout, prepare=lambda d: d.where("level = 'info'"))
    row = IN.read_ledger(spark, layout).head()
    assert (row["rows"], row["inserted"], row["failed"]) == (11, 5, 1)
    counted = M.counts(IN.read_metrics(spark, layout)).where("dimension = 'total'").head()
    assert counted["n"] == 5 == tables.read_table(spark, layout.logs).count()


# -- written term statistics ---------------------------------------------------------


@pytest.fixture
def searched(spark, tmp_path):
    """A written table with stored terms, and its statistics from two loads."""
    logs = S.store_terms(load_logs(spark, "/root/testdata/sf0.001"))
    logs.write.parquet(str(tmp_path / "logs"))
    half = F.col("id").cast("int") % 2 == 0
    for part in (logs.where(half), logs.where(~half)):
        S.term_statistics(part).write.mode("append").parquet(str(tmp_path / "statistics"))
    return spark.read.parquet(str(tmp_path / "logs")), S.merged(spark.read.parquet(str(tmp_path / "statistics")))


def scored(df):
    return sorted((r["id"], round(r["score"], 9)) for r in df.select("id", "score").collect())


def table_scans(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return sum("Relation [id#" in line for line in plan.splitlines())


@pytest.mark.parametrize(
    "run, scans",
    [
        (lambda t, s: S.match(t, "request timeout", statistics=s, operator="or"), 1),
        (lambda t, s: S.match_phrase(t, "request processed", 2, statistics=s), 1),
        (lambda t, s: S.multi_match(t, "databse connecton", statistics=s), 1),
        (lambda t, s: S.more_like_this(t, "96", statistics=s), 2),
    ],
)
def test_searches_with_statistics(searched, run, scans):
    table, statistics = searched
    with_them, without = run(table, statistics), run(table, None)
    assert scored(with_them) == scored(without)
    assert table_scans(with_them) == scans < table_scans(without)


def test_statistics_of_batches(spark, tmp_path, lines):
    docs = [entry(id=str(i), message="payment timeout" if i % 2 else "payment done") for i in range(6)]
    layout = IN.Layout(str(tmp_path / "run"))
    for batch in (0, 1, 1):
        IN.process_batch(lines(*docs), batch, layout)
    rows = IN.read_statistics(spark, layout).where("field = 'message'").collect()
    assert {r["term"]: r["df"] for r in rows} == {None: 12, "payment": 12, "timeout": 6, "done": 6}


def test_statistics_analyze_each_distinct_text_once(spark, logs):
    docs = [entry(id=str(i), message="the running runs of it", tags=["a", "b"]) for i in range(20)]
    docs += [entry(id="x", message=None), entry(id="y", message="", request={"path": "/p"}), entry(id="z", message="Runs")]
    table = logs(*docs)
    fields = [*S.SEARCH_FIELDS, S.TAGS]
    found = S.term_statistics(table, fields)
    plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    python = next(i for i, x in enumerate(plan) if "EvalPython" in x)
    assert any("Aggregate" in x for x in plan[python:])  # below the stemmer
    got = {(r["field"], r["term"]): (r["df"], r["n"], r["total"]) for r in found.collect()}
    assert got[("message", "run")] == (21, 0, None)
    assert got[("message", None)] == (23, 21, 41)
    assert got[("tags", "a")] == (20, 0, None) and got[("tags", None)] == (23, 23, 43)
    assert got[("request.path", "/p")] == (1, 0, None) and got[("request.path", None)] == (23, 1, 1)
    assert got[("error.message", None)] == (23, 0, 0)
    # the same from stored terms
    stored = S.term_statistics(S.store_terms(table, [S.MESSAGE, S.TAGS]), fields)
    assert {tuple(r) for r in stored.collect()} == {tuple(r) for r in found.collect()}


def test_events_of_one_row_group_are_dealt_to_all_cores(spark, sf_dir):
    from logloom.sources.events import dealt_events, load_events

    assert load_events(spark, sf_dir).rdd.getNumPartitions() == 1
    dealt = dealt_events(spark, sf_dir)
    # a kept table keeps the number
    kept = dealt.select("event_id").persist()
    assert kept.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert kept.count() == load_events(spark, sf_dir).count()
    kept.unpersist()


def test_only_refused_documents_are_kept(spark, lines, tmp_path, monkeypatch):
    seen = []
    whole = validation.rejects
    monkeypatch.setattr(validation, "rejects", lambda checked, *more: seen.append(checked) or whole(checked, *more))
    layout = IN.Layout(str(tmp_path / "l"))
    IN.process_batch(lines(entry(), "{oops"), 1, layout)
    kept = {r["document"] for r in seen[0].select("document").collect()}
    assert kept == {None, "{oops"}
    assert [r["details"]["document"] for r in IN.read_rejects(spark, layout).collect()] == ["{oops"]
