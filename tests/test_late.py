from datetime import datetime, timedelta

from pyspark.sql import functions as F

from logloom.streaming import ingest as IN
from logloom.streaming import late as LT

DAY = datetime(2024, 1, 1)


def times(spark, *minutes):
    rows = [(None if m is None else DAY + timedelta(minutes=m),) for m in minutes]
    return spark.createDataFrame(rows, "timestamp timestamp")


def read(spark, path, **kw):
    rows = LT.histogram(spark, path, **kw).select(F.unix_millis("bucket").alias("b"), "n", "late", "closed").collect()
    start = min(r["b"] for r in rows)
    return [((r["b"] - start) // 3_600_000, r["n"], r["late"], r["closed"]) for r in sorted(rows)]


def test_late_and_empty_buckets(spark, tmp_path):
    path = str(tmp_path / "c")
    for batch, minutes in enumerate([(5, 65, 70), (10, None, 250), (20, 62, 200, 251), (1, 240)]):
        LT.count_batch(times(spark, *minutes), batch, path)
    # after batch 0 the mark is 1:00, which ends the first hour; after batch 1 it is 4:00
    assert read(spark, path) == [(0, 1, 3, True), (1, 2, 1, True), (2, 0, 0, True), (3, 0, 1, True), (4, 3, 0, False)]
    LT.count_batch(times(spark, 240, 241), 3, path)
    assert read(spark, path)[0] == (0, 1, 2, True) and read(spark, path)[4] == (4, 4, 0, False)
    assert read(spark, path, delay="1d") == [
        (0, 3, 0, False), (1, 3, 0, False), (2, 0, 0, False), (3, 1, 0, False), (4, 4, 0, False)
    ]


def test_nothing_counted(spark, tmp_path):
    path = str(tmp_path / "c")
    LT.count_batch(times(spark, 5), 0, path)
    LT.count_batch(times(spark, None), 1, path)
    assert read(spark, path) == [(0, 1, 0, False)]


def test_agrees_with_the_watermark_of_spark(spark, tmp_path):
    """Closed buckets have the counts of Spark's own windows, which drop late records."""
    root = str(tmp_path)
    for k in range(3):
        minutes = [(i * 37 + k * 300) % 1000 for i in range(40)]
        times(spark, *minutes).coalesce(1).write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema("timestamp timestamp").parquet(f"{root}/in")
        LT.count_stream(stream, f"{root}/counts", f"{root}/check").awaitTermination()
        windows = IN.stream_histogram(stream).writeStream.outputMode("append").format("parquet")
        windows = windows.option("checkpointLocation", f"{root}/own").trigger(availableNow=True)
        windows.start(f"{root}/windows").awaitTermination()
    mine = LT.histogram(spark, f"{root}/counts")
    assert mine.agg(F.sum("late")).head()[0] > 0
    closed = mine.where("closed AND n > 0").select("bucket", "n").orderBy("bucket").collect()
    assert closed == spark.read.parquet(f"{root}/windows").orderBy("bucket").collect()
