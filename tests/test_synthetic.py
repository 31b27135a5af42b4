from pyspark.sql import functions as F

from logloom import schema as S
from logloom.plans import scenarios as SC
from logloom.sources import synthetic as SY
from logloom.sources import tables


def test_fields_are_in_range(spark):
    rows = SY.finish(SY.generate(spark, 2000, "2024-01-01")).cache()
    assert rows.schema.simpleString() == S.LOG_SCHEMA.simpleString()
    bad = rows.where(
        ~F.col("level").isin(S.LEVELS)
        | ~F.col("service.environment").isin(S.ENVIRONMENTS)
        | ~F.col("service.name").isin(S.SERVICES)
        | ~F.col("category").isin(S.CATEGORIES)
        | ~F.col("metrics.cpu_usage").between(0, 100)
        | ~F.col("metrics.memory_mb").between(128, 2048)
        | ~F.col("metrics.response_time_ms").between(10, 5000)
        | ~F.col("metrics.db_query_time_ms").between(5, 500)
        | (F.to_date("timestamp") != "2024-01-01")
        | (F.col("error").isNotNull() != F.col("level").isin("error", "fatal"))
        | (F.col("tags")[0] != F.col("service.name"))
        | F.col("message").isNull()
    )
    assert bad.count() == 0
    assert rows.select("id").distinct().count() == 2000
    share = rows.agg(
        F.avg((F.col("level") == "info").cast("int")).alias("info"),
        F.avg((F.col("service.environment") == "production").cast("int")).alias("prod"),
        F.avg(F.col("request").isNotNull().cast("int")).alias("request"),
        F.avg(F.hour("timestamp").between(10, 17).cast("int")).alias("busy"),
    ).head()
    assert 0.55 < share["info"] < 0.65 and 0.65 < share["prod"] < 0.75
    assert 0.75 < share["request"] < 0.85 and 0.68 < share["busy"] < 0.79


def test_rows_do_not_depend_on_the_partitioning(spark):
    one = SY.generate(spark, 500, "2024-01-01").coalesce(1)
    many = SY.synthesize(spark.range(500).withColumnRenamed("id", "seq").repartition(7), "2024-01-01")
    assert one.exceptAll(many).count() == 0
    other = SY.generate(spark, 500, "2024-01-01", seed=7)
    assert one.select("id").intersect(other.select("id")).count() == 0


def test_profiles(spark):
    rows = SY.generate(spark, 1000, "2024-01-01")
    failing = SY.failing(rows)
    assert failing.where("timestamp IS NULL").count() == 20
    diverse = SY.diverse(rows)
    # the level changes after the error object was set
    assert diverse.where("level = 'error' AND error IS NULL").count() > 0
    phrases = SY.search_profile(rows)
    first = phrases.where("seq = 0").head()
    assert first["message"] == "payment gateway timeout error" and "search-demo" in first["tags"]
    five = phrases.where("seq = 5").head()
    assert five["message"] == "payment gateway timeout error resolved after retry"
    seven = phrases.where("seq = 7").head()
    assert seven["message"] == "order near processing completed detected"
    assert seven["tags"][-2:] == ["search-demo", "near-match"]


def test_scenarios_run(spark, tmp_path):
    sizes = {}
    for scenario in SC.SCENARIOS:
        results = SC.run(spark, scenario, str(tmp_path / "t"), "2024-01-01", total=3000)
        sizes[scenario] = {name: len(df.collect()) for name, df in results.items()}
    assert sizes["massive-bulk"] == {
        "level distribution": 6, "top services": 9, "response time percentiles": 5
    }
    assert sizes["query-diversity"] == {
        "error rate by environment": 3, "slow requests": 5, "time series": 12
    }
    assert sizes["failure-recovery"] == {
        "missing timestamps": 1, "fatal and error": 2, "failed documents": 5
    }
    assert sizes["search-experiments"] == {"match": 5, "phrase": 5, "fuzzy": 5}
    table = tables.read_table(spark, str(tmp_path / "t"))
    assert table.where("family = 'logs-failure' AND timestamp IS NULL").count() == 60
    assert {r["family"] for r in table.select("family").distinct().collect()} == {
        "logs-massive", "logs-queries", "logs-failure", "logs-search"
    }


def test_a_failing_scenario_does_not_stop_the_rest(spark, tmp_path):
    asked = ["no-such-scenario", "failure-recovery"]
    bad, good = SC.run_all(spark, str(tmp_path / "t"), "2024-01-01", asked, total=500)
    assert bad.error.startswith("KeyError") and not bad.queries and bad.inserted == 0
    assert good.error is None and good.inserted == 500 and good.rate > 0
    assert good.queries["missing timestamps"].head()["n"] > 0
    more, = SC.run_all(spark, str(tmp_path / "t"), "2024-01-01", asked[1:], total=300)
    assert more.inserted == 300
    anew, = SC.run_all(spark, str(tmp_path / "t"), "2024-01-01", asked[1:], total=200, force=True)
    assert anew.error is None and 200 <= anew.inserted <= 1000
