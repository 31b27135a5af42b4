"""Newline-delimited JSON: one document per line, and the bulk form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

JSON_OPTIONS = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'",
    "timeZone": "UTC",
    "ignoreNullFields": "true",
}


def write_ndjson(logs: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One object per line; absent fields are left out."""
    logs.write.mode(mode).options(**JSON_OPTIONS).json(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Raw lines, to be validated; blank lines are no documents."""
    return spark.read.text(path).where(F.trim("value") != "")


def documents(logs: DataFrame) -> Column:
    return F.to_json(F.struct(*[F.col(c) for c in logs.columns]), JSON_OPTIONS)


def bulk_lines(logs: DataFrame, target: Column | str) -> DataFrame:
    """Two lines per record, the action and the document: ``(id, ordinal, line)``.

    The two lines of a record stay next to each other in one partition.
    """
    name = F.lit(target) if isinstance(target, str) else target
    action = F.to_json(F.struct(F.struct(name.alias("_index")).alias("index")))
    return logs.select(
        "id", F.posexplode(F.array(action, documents(logs))).alias("ordinal", "line")
    )


def write_bulk(logs: DataFrame, target: Column | str, path: str) -> None:
    bulk_lines(logs, target).select("line").write.text(path)
