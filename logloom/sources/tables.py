"""The log table: Parquet, partitioned by family and day."""

from __future__ import annotations

import re
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import table_name

PARTITIONS = ["family", "log_date"]
MAX_RECORDS_PER_FILE = 5_000_000


def partitioned(logs: DataFrame, family: Column | str = "logs") -> DataFrame:
    """Add the partition columns; records without a timestamp get a null day."""
    name = F.lit(family) if isinstance(family, str) else family
    return logs.withColumn("family", name).withColumn("log_date", F.to_date("timestamp"))


def write_table(
    logs: DataFrame,
    path: str,
    family: Column | str = "logs",
    force: bool = False,
    sort: bool = True,
    extra_partitions: tuple[str, ...] = (),
) -> None:
    """Append, or with ``force`` replace the days that occur in ``logs``.

    ``rebalance`` brings a day's rows together in files of the advised size: AQE
    splits a day that is too large for one task and merges small ones. Rows are
    in time order within a file, so that row groups can be skipped, and a Bloom
    filter on ``id`` lets a lookup skip those without it.
    """
    columns = [*PARTITIONS, *extra_partitions]
    out = partitioned(logs, family).hint("rebalance", *columns)
    if sort:
        out = out.sortWithinPartitions(*columns, "timestamp")
    (
        out.write.mode("overwrite" if force else "append")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "zstd")
        .option("maxRecordsPerFile", MAX_RECORDS_PER_FILE)
        .option("parquet.bloom.filter.enabled#id", "true")
        .option("parquet.bloom.filter.adaptive.enabled", "true")
        .partitionBy(*columns)
        .parquet(path)
    )


def read_table(spark: SparkSession, path: str, root: str | None = None) -> DataFrame:
    """The table, with the types of the partition columns as they were written.

    Left to itself Spark would guess them from the folder names, and take the
    family ``007`` for a number. ``path`` may be a pattern of folders of the table
    at ``root``.
    """
    reader = spark.read.option("basePath", root or path)
    found = reader.parquet(path).schema
    types = {"family": T.StringType(), "log_date": T.DateType()}
    schema = T.StructType(
        [T.StructField(f.name, types.get(f.name, f.dataType), f.nullable) for f in found]
    )
    return reader.schema(schema).parquet(path)


def _files(spark: SparkSession, path: str):
    """The file system of a path, and the path in its terms."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    files, where = _files(spark, path)
    return files.exists(where)


def matches(spark: SparkSession, pattern: str) -> bool:
    """Whether there is any path that a pattern names."""
    files, where = _files(spark, pattern)
    return bool(files.globStatus(where))


def mark(spark: SparkSession, path: str) -> bool:
    """Leave an empty file at ``path``; whether it was not there before."""
    files, where = _files(spark, path)
    return files.createNewFile(where)


def remove(spark: SparkSession, *patterns: str) -> None:
    """Remove the folders that the patterns name."""
    for pattern in patterns:
        files, where = _files(spark, pattern)
        for found in files.globStatus(where) or []:
            if not files.delete(found.getPath(), True):
                raise OSError(f"could not remove {found.getPath()}")


def name_regex(pattern: str) -> str:
    """A ``*`` pattern as a regular expression over whole names."""
    return "^" + ".*".join(re.escape(p) for p in pattern.split("*")) + "$"


def partition_name() -> Column:
    """``family-day``; a partition without a day is named ``family-unknown``."""
    day = F.coalesce(F.col("log_date").cast("string"), F.lit("unknown"))
    return table_name(F.col("family"), day)


def scope(
    table: DataFrame,
    pattern: str | None = None,
    names: list[str] | None = None,
    day: str | date | None = None,
    family: str = "logs",
) -> DataFrame:
    """Part of the table: a name pattern, given names, or one day of a family.

    All three are conditions on partition columns, so other days are not read.
    """
    if day is not None:
        table = table.where((F.col("family") == family) & (F.col("log_date") == F.lit(day).cast("date")))
    if pattern is not None:
        table = table.where(partition_name().rlike(name_regex(pattern)))
    if names is not None:
        table = table.where(partition_name().isin(names))
    return table
