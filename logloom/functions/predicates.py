"""Named predicates over log records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CRITICAL_LEVELS = ["error", "fatal"]


def error_exists() -> Column:
    """Some searchable part of ``error`` is present; ``{}`` does not count."""
    e = F.col("error")
    return F.coalesce(e["type"], e["message"], e["code"]).isNotNull()


def error_object() -> Column:
    """The record carries an ``error`` object, even an empty one."""
    return F.col("error").isNotNull()


def critical_level() -> Column:
    """The level says error or fatal, whatever ``error`` holds."""
    return F.col("level").isin(CRITICAL_LEVELS)


def missing(path: str) -> Column:
    return F.col(path).isNull()
