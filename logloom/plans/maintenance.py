"""Table statistics, retention and compaction."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import date_bounds, format_bytes
from ..sources import manifest, tables


def partition_stats(table: DataFrame) -> DataFrame:
    """Rows, files and bytes of each partition, largest first.

    Rows are counted per file from the file footers; no column is read.
    """
    per_file = table.groupBy(
        "family",
        "log_date",
        F.col("_metadata.file_path").alias("file"),
    ).agg(F.count(F.lit(1)).alias("rows"), F.max("_metadata.file_size").alias("bytes"))
    return _by_partition(per_file)


def manifest_stats(files: DataFrame) -> DataFrame:
    """``partition_stats`` from the manifest, with the first and last time of each partition.

    The table is not touched: neither listed nor opened.
    """
    return _by_partition(files, F.min("first").alias("first"), F.max("last").alias("last"))


def _by_partition(per_file: DataFrame, *more: Column) -> DataFrame:
    return (
        per_file.groupBy("family", "log_date")
        .agg(
            F.sum("rows").alias("documents"),
            F.count(F.lit(1)).alias("files"),
            F.sum("bytes").alias("size_bytes"),
            F.collect_set(F.regexp_replace("file", "/[^/]*$", "")).alias("folders"),
            *more,
        )
        .withColumn("name", tables.partition_name())
        .withColumn("size", format_bytes("size_bytes"))
        .orderBy(F.col("size_bytes").desc(), F.col("name").asc())
    )


def stats_summary(stats: DataFrame, family_prefix: str = "logs") -> DataFrame:
    """Number of partitions, rows and bytes of the families with a prefix."""
    chosen = stats.where(F.startswith(F.col("family"), F.lit(family_prefix)))
    return chosen.agg(
        F.count(F.lit(1)).alias("tables"),
        F.coalesce(F.sum("documents"), F.lit(0)).alias("documents"),
        F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("size_bytes"),
    ).withColumn("size", format_bytes("size_bytes"))


def older_than(stats: DataFrame, days: int, as_of: str | date | datetime) -> DataFrame:
    """Partitions dated strictly before ``as_of`` minus ``days``.

    One without a day is kept.
    """
    moment = datetime(as_of.year, as_of.month, as_of.day) if type(as_of) is date else as_of
    cutoff = date_bounds(moment)[0] - timedelta(days=days)
    return stats.where(F.col("log_date").cast("timestamp") < F.lit(cutoff))


def retention_plan(
    stats: DataFrame,
    days: int | None = None,
    as_of: str | date | datetime | None = None,
    names: list[str] | None = None,
    pattern: str | None = None,
) -> DataFrame:
    """What a clean-up would delete. Named partitions are taken whatever their age."""
    if names:
        return stats.where(F.col("name").isin(names))
    if pattern is not None:
        stats = stats.where(F.col("name").rlike(tables.name_regex(pattern)))
    if not days:
        return stats
    if as_of is None:
        raise ValueError("as_of is needed to tell how old a partition is")
    return older_than(stats, days, as_of)


def plan_totals(plan: DataFrame) -> DataFrame:
    return plan.agg(
        F.count(F.lit(1)).alias("tables"),
        F.coalesce(F.sum("documents"), F.lit(0)).alias("documents"),
        F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("size_bytes"),
    ).withColumn("size", format_bytes("size_bytes"))


@dataclass(frozen=True)
class Deleted:
    deleted: int
    failed: int


def _is_partition_of(root, folder) -> bool:
    """Whether a folder is ``root/family=…/log_date=…``, or a level below."""
    names = []
    while folder is not None and not folder.equals(root):
        names.append(folder.getName())
        folder = folder.getParent()
    top = names[-2:][::-1]
    return (
        folder is not None
        and len(top) == 2
        and top[0].startswith("family=")
        and top[1].startswith("log_date=")
        and not any(n in (".", "..") for n in names)
    )


#: Folders that are deleted at the same time.
DELETES = 16


def apply_retention(
    spark: SparkSession, path: str, plan: DataFrame, confirm: bool = False, manifest_root: str | None = None
) -> Deleted:
    """Delete the planned partitions of the table at ``path``.

    Refuses unless ``confirm`` is set. A partition is a folder, so the work does
    not grow with what is kept; several are deleted at a time. The plan has one
    row per partition, which is all that comes to the driver. The folders are
    those that the table's files were found in, never built from values; one that
    is not a partition of this table is left alone and counted as failed. A folder
    that is gone already counts as deleted, so that a plan can be carried out
    again after a failure. With ``manifest_root`` the files are noted as removed.
    """
    if not confirm:
        raise PermissionError("nothing was deleted: pass confirm=True to delete")
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(conf)
    root = files.makeQualified(root)

    def delete(folders: list[str]) -> list[str]:
        """The folders of one partition that are gone."""
        gone = []
        for folder in folders:
            try:
                where = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
                below = _is_partition_of(root, files.makeQualified(where))
                if below and (files.delete(where, True) or not files.exists(where)):
                    gone.append(folder)
            except Exception:  # noqa: BLE001 - a partition that cannot be deleted is counted
                pass
        return gone

    planned = [row["folders"] for row in plan.select("folders").toLocalIterator()]
    with ThreadPoolExecutor(DELETES) as pool:
        gone = list(pool.map(delete, planned))
    if manifest_root is not None:
        manifest.forget(spark, manifest_root, [folder for g in gone for folder in g])
    deleted = sum(len(g) == len(p) for g, p in zip(gone, planned))
    return Deleted(deleted, len(planned) - deleted)


def compact(
    spark: SparkSession,
    path: str,
    out: str | None = None,
    where: Column | None = None,
    cluster: tuple[str, ...] = (),
    max_records: int = tables.MAX_RECORDS_PER_FILE,
) -> None:
    """Rewrite partitions as few, time-ordered files after a bulk load.

    In place, a partition is replaced only when its new files are complete. To a
    new folder, partition levels below the day (the batches of a stream) are
    merged. With ``cluster``, such as ``CLUSTER``, the rows of a day are not in
    order of time but along a curve through several columns, so that filters on
    any of them skip files and row groups.
    """
    table = tables.read_table(spark, path)
    if where is not None:
        table = table.where(where)
    if out is None:
        if "batch" in table.columns:
            raise ValueError("a table with batches is compacted to a new folder")
        _rewrite(table, path, cluster, max_records)
    else:
        _rewrite(table.drop("batch"), out, cluster, max_records)


def _rewrite(table: DataFrame, path: str, cluster: tuple[str, ...], max_records: int) -> None:
    columns = tables.PARTITIONS
    if cluster:
        keyed = on_curve(table, cluster, "__key")
        order = [*columns, "__key"]
        # a day of any size is dealt to several tasks, each with a part of the curve
        ordered = keyed.repartitionByRange(*order).sortWithinPartitions(*order).drop("__key")
    else:
        ordered = table.hint("rebalance", *columns).sortWithinPartitions(*columns, "timestamp")
    (
        ordered.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "zstd")
        .option("maxRecordsPerFile", max_records)
        .option("parquet.bloom.filter.enabled#id", "true")
        .option("parquet.bloom.filter.adaptive.enabled", "true")
        .partitionBy(*columns)
        .parquet(path)
    )


#: The columns that filters name most.
CLUSTER = ("level", "service.name", "timestamp")
_RANK_BITS = 6


def _ordinal(table: DataFrame, name: str) -> Column:
    """A number that grows with the value; of a text its first seven bytes."""
    kind = table.select(F.col(name).alias("c")).schema["c"].dataType
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(name)
    if isinstance(kind, T.StringType):
        return F.conv(F.rpad(F.hex(F.encode(F.col(name), "UTF-8")), 14, "0"), 16, 10).cast("bigint")
    if isinstance(kind, T.NumericType):
        return F.col(name).cast("double")
    raise ValueError(f"rows cannot be clustered by {name} of type {kind.simpleString()}")


def on_curve(table: DataFrame, cluster: tuple[str, ...], key: str) -> DataFrame:
    """The table with the place of each row on a Morton curve through the columns, as ``key``.

    Values are replaced by their rank among at most 63 approximate quantiles, so a
    skewed column takes part like any other; the bits of the ranks are interleaved,
    the first column's first. The quantiles take one scan of these columns and are
    all that comes to the driver. A missing value has rank 0.
    """
    ordinals = [_ordinal(table, name) for name in cluster]
    parts = [i / 2**_RANK_BITS for i in range(1, 2**_RANK_BITS)]
    found = table.agg(*[F.percentile_approx(o, parts).alias(f"q{i}") for i, o in enumerate(ordinals)]).head()
    # columns of a projection of their own: each is worked out once and then compared a few times
    named = [f"__ordinal{i}" for i in range(len(cluster))]
    kept = table.columns
    table = table.select("*", *[o.alias(n) for o, n in zip(ordinals, named)])

    def spread(rank: int, i: int) -> int:
        """The bits of a rank at the places of column ``i``."""
        last = len(cluster) - 1 - i
        return sum((rank >> bit & 1) << (bit * len(cluster) + last) for bit in range(_RANK_BITS))

    def place(i: int, bounds: list, low: int, high: int) -> Column:
        """The spread rank, known to be between two ranks, by halving."""
        if low == high:
            return F.lit(spread(low, i)).cast("bigint")
        middle = (low + high) // 2
        above = F.col(named[i]) >= F.lit(bounds[middle])
        return F.when(above, place(i, bounds, middle + 1, high)).otherwise(place(i, bounds, low, middle))

    # a value that fills several quantiles counts as often, which spreads the ranks of few values
    position = F.lit(0).cast("bigint")
    for i, bounds in enumerate(found):
        position = position.bitwiseOR(place(i, bounds or [], 0, len(bounds or [])))
    return table.select(*kept, position.alias(key))
