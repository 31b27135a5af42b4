"""One row for each file of the log table, written with each load.

Statistics and retention plans made from it open neither the table nor its file
footers. Two tables lie below a root: the files of each batch, and those that a
clean-up has removed since.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tables

_KEYS = ["family", "log_date", "file"]


def files_of(table: DataFrame) -> DataFrame:
    """``(family, log_date, file, rows, bytes, first, last)``; only the time is read.

    ``first`` and ``last`` are null for a file without any timestamp.
    """
    return table.groupBy("family", "log_date", F.col("_metadata.file_path").alias("file")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.max("_metadata.file_size").alias("bytes"),
        F.min("timestamp").alias("first"),
        F.max("timestamp").alias("last"),
    )


def record(spark: SparkSession, path: str, root: str, batch_id: int) -> None:
    """Write the rows of one batch's files, in place of what an earlier attempt wrote.

    Only the folders of the batch are listed, and only its own files are read.
    A batch that stored nothing has no row.
    """
    below = f"{path}/family=*/log_date=*/batch={batch_id}"
    if tables.matches(spark, below):
        table = tables.read_table(spark, below, path)
        _put(files_of(table), root, batch_id)


def rebuild(spark: SparkSession, path: str, root: str, batch_id: int = 0) -> None:
    """Write the rows of a whole table that was not loaded in batches, as one batch."""
    _put(files_of(tables.read_table(spark, path)), root, batch_id)


def _put(files: DataFrame, root: str, batch_id: int) -> None:
    (
        files.withColumn("batch", F.lit(batch_id))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("batch")
        .parquet(f"{root}/files")
    )


def read(spark: SparkSession, root: str) -> DataFrame:
    """The files that the table has now."""
    files = spark.read.parquet(f"{root}/files")
    if tables.exists(spark, f"{root}/removed"):
        files = files.join(spark.read.parquet(f"{root}/removed"), "file", "left_anti")
    return files.select("batch", *_KEYS, "rows", "bytes", "first", "last")


def forget(spark: SparkSession, root: str, folders: list[str]) -> None:
    """Note the files of removed folders; file names never come again."""
    if folders:
        gone = spark.createDataFrame([(f,) for f in folders], "folder string")
        folder = F.regexp_replace("file", "/[^/]*$", "")
        files = read(spark, root).withColumn("folder", folder).join(gone, "folder", "left_semi")
        files.select("file").write.mode("append").parquet(f"{root}/removed")


def between(files: DataFrame, start, end) -> DataFrame:
    """Files that can hold records of a time range, both ends included."""
    return files.where((F.col("last") >= F.lit(start)) & (F.col("first") <= F.lit(end)))
