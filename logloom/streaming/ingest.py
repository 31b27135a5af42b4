"""Continuous ingestion of newline-delimited JSON with Structured Streaming."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import metrics, postings, search, sketches
from ..sources import manifest, ndjson, synthetic, tables, validation


@dataclass(frozen=True)
class Layout:
    """Where a run keeps its tables; all below one shared folder."""

    root: str

    @property
    def logs(self) -> str:
        return f"{self.root}/logs"

    @property
    def rejects(self) -> str:
        return f"{self.root}/rejects"

    @property
    def ledger(self) -> str:
        return f"{self.root}/ledger"

    @property
    def metrics(self) -> str:
        return f"{self.root}/metrics"

    @property
    def statistics(self) -> str:
        return f"{self.root}/statistics"

    @property
    def sketches(self) -> str:
        return f"{self.root}/sketches"

    @property
    def postings(self) -> str:
        return f"{self.root}/postings"

    @property
    def manifest(self) -> str:
        return f"{self.root}/manifest"

    @property
    def working(self) -> str:
        return f"{self.root}/working"

    @property
    def checkpoint(self) -> str:
        return f"{self.root}/checkpoint"


def _begin(spark: SparkSession, layout: Layout, batch_id: int) -> None:
    """Mark the batch as begun, and remove all that an earlier attempt left of it, in every output.

    An attempt may have written days or rejects that this one will not write, so
    replacing what is written again would not do. Without a mark there was no
    attempt, and no folder has to be listed.
    """
    mark = f"{layout.root}/attempts/{batch_id}"
    if not tables.mark(spark, mark):
        outputs = (
            layout.logs, layout.rejects, layout.metrics, layout.statistics, layout.sketches, layout.postings,
            layout.manifest, layout.ledger, layout.working,
        )
        for path in outputs:
            below = ("", "/*", "/*/*")  # postings have a folder for each table, logs for family and day
            tables.remove(spark, *(f"{path}{b}/batch={batch_id}" for b in below))


def _write_batch(df: DataFrame, path: str, batch_id: int, kind: str = "parquet") -> None:
    out = df.withColumn("batch", F.lit(batch_id)).write.mode("append").partitionBy("batch").format(kind)
    if kind == "json":  # refused documents are written out whole
        out = out.option("compression", "gzip")
    out.save(path)


#: Ids of every batch so far, as ``remember_ids``.
ALWAYS = "always"
#: Days of a batch up to which the search for stored ids is limited to these days.
MAX_DAYS = 4000


#: Number of a row in the working folder of its batch.
ROW = "__row"
#: Rows of a batch up to which the marks of the new ones, a bit for each row, are sent to every task.
MAX_MARKED = 1 << 26


def _numbered(checked: DataFrame, layout: Layout, batch_id: int) -> DataFrame:
    """The checked rows, written to the working folder and read again, each with a number that stays.

    The files are far smaller than a cached table would be on disk.
    """
    path = f"{layout.working}/batch={batch_id}"
    rows = checked.withColumn(ROW, F.monotonically_increasing_id())
    rows.write.option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def new_documents(good: DataFrame, layout: Layout, batch_id: int, remember: str) -> DataFrame:
    """Accepted, numbered records whose id was not stored under the same day by an earlier batch, each once.

    ``remember`` limits the earlier batches to those that ended within an
    interval before now. Only the id column of the days that occur here is read.
    Records without an id are all new. Refused documents are not stored and so
    do not keep out their corrected version. Only ids, days and numbers are
    shuffled; the records are picked by the marks of their numbers.
    """
    spark = good.sparkSession
    named = good.where(F.col("id").isNotNull()).select("id", F.to_date("timestamp").alias("day"), ROW)
    seen = named
    if tables.matches(spark, f"{layout.logs}/family=*") and tables.exists(spark, layout.ledger):
        earlier = spark.read.parquet(layout.ledger).where(F.col("batch_id") != batch_id)
        if remember != ALWAYS:
            earlier = earlier.where(F.col("finished") >= F.current_timestamp() - F.expr(f"INTERVAL {remember}"))
        stored = tables.read_table(spark, layout.logs).where(F.col("id").isNotNull()).select("id", "log_date", "batch")
        days = [r["day"] for r in named.select("day").distinct().limit(MAX_DAYS + 1).collect()]
        if len(days) <= MAX_DAYS:
            known = [d for d in days if d is not None]
            stored = stored.where(F.col("log_date").isin(known) | F.col("log_date").isNull())
        stored = stored.join(earlier.select(F.col("batch_id").alias("batch")), "batch", "left_semi")
        seen = named.unionByName(stored.select("id", F.col("log_date").alias("day"), F.lit(None).cast("bigint").alias(ROW)))
    # a stored record has no number
    first = seen.groupBy("id", "day").agg(F.min(ROW).alias(ROW), F.count_if(F.col(ROW).isNull()).alias("stored"))
    new = first.where("stored = 0").select(ROW).unionByName(good.where(F.col("id").isNull()).select(ROW))
    word = F.shiftright(ROW, 6)
    marks = new.groupBy(word.alias("__word")).agg(F.expr(f"bit_or(shiftleft(1L, int({ROW} & 63)))").alias("__marks"))
    if good.select(ROW).count() <= MAX_MARKED:
        marks = F.broadcast(marks)
    marked = good.withColumn("__word", word).join(marks, "__word")
    return marked.where(F.expr(f"getbit(__marks, int({ROW} & 63)) = 1")).select(*[c for c in good.columns if c != ROW])


def _stored_rows(good: DataFrame, layout: Layout, batch_id: int) -> DataFrame:
    """The rows of ``good`` as this batch has stored them."""
    spark = good.sparkSession
    below = f"{layout.logs}/family=*/log_date=*/batch={batch_id}"
    if not tables.matches(spark, below):
        return spark.createDataFrame([], good.schema)
    return tables.read_table(spark, below, layout.logs).select(*good.columns)


def process_batch(
    lines: DataFrame,
    batch_id: int,
    layout: Layout,
    family: str = "logs",
    required: tuple[str, ...] = (),
    prepare: Callable[[DataFrame], DataFrame] | None = None,
    remember_ids: str | None = None,
    with_postings: bool = False,
) -> None:
    """Validate one batch and write records, rejects, metrics, term statistics and its ledger row.

    ``lines`` may be a batch of a stream or any table of lines. A batch that
    runs again, after a failure or with corrected input, takes the place of all
    its first run left, in every output. The checked rows are kept while the
    outputs are written; lost pieces are computed again from the input.
    With ``remember_ids`` accepted documents that are stored already are left out
    (``new_documents``), and the checked rows are kept in the working folder;
    ``with_postings`` also writes the search index. ``inserted`` counts the rows that this and ``prepare``
    leave, which are those of the table and of the metrics; these are read from the table.
    """
    start = time.time()
    spark = lines.sparkSession
    _begin(spark, layout, batch_id)
    checked = validation.validate(lines, required=required)
    # only a refused document is written out again; those of accepted records would be half of what is kept
    refused = F.when(F.size("reject_reasons") > 0, F.col("document"))
    checked = checked.withColumn("document", refused)
    try:
        checked = _numbered(checked, layout, batch_id) if remember_ids else checked.persist()
        good = validation.accepted(checked)
        if remember_ids:
            good = new_documents(good, layout, batch_id, remember_ids)
        if prepare is not None:
            good = good.transform(prepare)
        tables.write_table(
            good.withColumn("batch", F.lit(batch_id)),
            layout.logs,
            family,
            extra_partitions=("batch",),
        )
        manifest.record(spark, layout.logs, layout.manifest, batch_id)
        if remember_ids or prepare is not None:
            good = _stored_rows(good, layout, batch_id)
        bad = validation.rejects(checked, "stream", F.lit(batch_id).cast("bigint"))
        _write_batch(bad, layout.rejects, batch_id, "json")
        _write_batch(metrics.partials(good), layout.metrics, batch_id)
        _write_batch(search.term_statistics(good), layout.statistics, batch_id)
        _write_batch(sketches.value_sketches(good), layout.sketches, batch_id)
        if with_postings:
            postings.write(good, layout.postings, batch_id=batch_id)
        counted = checked.agg(
            F.count(F.lit(1)).alias("rows"),
            F.count_if(F.size("reject_reasons") > 0).alias("failed"),
        )
        inserted = good.agg(F.count(F.lit(1)).alias("n"))
        spent = int((time.time() - start) * 1000)
        row = counted.select(
            F.lit(batch_id).cast("bigint").alias("batch_id"),
            "rows",
            inserted.scalar().alias("inserted"),
            "failed",
            F.lit(spent).cast("bigint").alias("duration_ms"),
            F.current_timestamp().alias("finished"),
        )
        _write_batch(row, layout.ledger, batch_id)
    finally:
        checked.unpersist()
        tables.remove(spark, f"{layout.working}/batch={batch_id}")


def load(
    spark: SparkSession,
    source: str,
    layout: Layout,
    batch_id: int,
    family: str = "logs",
    required: tuple[str, ...] = (),
    prepare: Callable[[DataFrame], DataFrame] | None = None,
    remember_ids: str | None = None,
    with_postings: bool = False,
) -> None:
    """Load a folder of lines as one batch: records, rejects, metrics and ledger.

    With ``remember_ids=ALWAYS`` a file that is loaded again as another batch is
    stored once.
    """
    lines = spark.read.text(source).where(F.trim("value") != "")
    process_batch(lines, batch_id, layout, family, required, prepare, remember_ids, with_postings)


#: Input of one micro-batch, unless the caller says otherwise.
BATCH_BYTES = 8 * 1024**3


def ingest(
    spark: SparkSession,
    source: str,
    layout: Layout,
    family: str = "logs",
    required: tuple[str, ...] = (),
    files_per_batch: int | None = None,
    prepare: Callable[[DataFrame], DataFrame] | None = None,
    continuous: bool = False,
    remember_ids: str | None = None,
    with_postings: bool = False,
) -> StreamingQuery:
    """Ingest the files of a folder; by default what is there, then stop.

    A backlog is taken in batches of bounded size. With ``remember_ids`` (such as
    ``1 hour``, or ``ALWAYS``) an accepted document is left out if one with its id
    was stored under its day within that time.
    """
    reader = spark.readStream.format("text")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    else:
        reader = reader.option("maxBytesPerTrigger", BATCH_BYTES)
    lines = reader.load(source).where(F.trim("value") != "")

    def run(batch: DataFrame, batch_id: int) -> None:
        process_batch(batch, batch_id, layout, family, required, prepare, remember_ids, with_postings)

    writer = lines.writeStream.foreachBatch(run).option("checkpointLocation", layout.checkpoint)
    return (writer if continuous else writer.trigger(availableNow=True)).start()


def generate(
    spark: SparkSession,
    layout: Layout,
    total: int,
    batch_size: int,
    base_date: Column | str,
    seed: int = 42,
    profile: Callable[[DataFrame], DataFrame] | None = None,
    document: Callable[[DataFrame], Column] | None = None,
    family: str = "logs",
    partitions: int | None = None,
) -> None:
    """Ingest ``total`` synthetic records as a stream, ``batch_size`` at a time, and end.

    The numbers come from Spark's rate source, whose batches have a fixed number of rows;
    a record is a function of its number, so a batch that runs again is the same
    batch, and a second call on a finished run adds nothing. ``profile`` changes
    the records, ``document`` the line that is made of one (with its ``seq``).
    Each batch goes through validation, metrics, term statistics and the ledger.
    """
    batches = -(-total // batch_size)
    reader = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", batch_size)
    if partitions:
        reader = reader.option("numPartitions", partitions)
    rows = reader.load().where(F.col("value") < total).select(F.col("value").alias("seq"))
    # only the numbers are dealt out, however few partitions the source has: all cores make and check records
    rows = rows.repartition(max(partitions or 1, spark.sparkContext.defaultParallelism), "seq")
    records = synthetic.synthesize(rows, base_date, seed)
    if profile is not None:
        records = records.transform(profile)
    line = document(records) if document is not None else ndjson.documents(synthetic.finish(records))
    lines = records.select(line.alias("value"))

    def run(batch: DataFrame, batch_id: int) -> None:
        if batch_id < batches:  # the source never ends
            process_batch(batch, batch_id, layout, family)

    query = lines.writeStream.foreachBatch(run).option("checkpointLocation", layout.checkpoint).start()
    try:
        while not query.awaitTermination(1):
            last = query.lastProgress
            if last is not None and last["batchId"] >= batches - 1:
                break
    finally:
        query.stop()


def read_ledger(spark: SparkSession, layout: Layout) -> DataFrame:
    return spark.read.parquet(layout.ledger).drop("batch", "finished")


def read_metrics(spark: SparkSession, layout: Layout) -> DataFrame:
    """The metrics of all batches so far, merged."""
    return metrics.merge(spark.read.parquet(layout.metrics).drop("batch"))


def read_manifest(spark: SparkSession, layout: Layout) -> DataFrame:
    """The files of the table as the loads have written them, without removed ones."""
    return manifest.read(spark, layout.manifest)


def read_sketches(spark: SparkSession, layout: Layout) -> DataFrame:
    """The quantile sketches of all batches so far, to be filtered and merged."""
    return spark.read.parquet(layout.sketches)


def read_statistics(spark: SparkSession, layout: Layout) -> DataFrame:
    """The term statistics of all batches so far, merged."""
    return search.merged(spark.read.parquet(layout.statistics).drop("batch"))


def read_rejects(spark: SparkSession, layout: Layout) -> DataFrame:
    return spark.read.json(layout.rejects)


def drop_repeats(stream: DataFrame, delay: str = "1 hour", time_column: str = "timestamp") -> DataFrame:
    """Keep the first record of each id; ids are remembered for ``delay`` only."""
    return stream.withWatermark(time_column, delay).dropDuplicatesWithinWatermark(["id"])


def stream_histogram(
    stream: DataFrame, interval: str = "1 hour", delay: str = "10 minutes"
) -> DataFrame:
    """Counts per time bucket of a stream, emitted once a bucket can change no more.

    State is one counter per open bucket. Empty buckets are added when the result
    is read.
    """
    return (
        stream.withWatermark("timestamp", delay)
        .groupBy(F.window("timestamp", interval))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("window.start").alias("bucket"), "n")
    )
