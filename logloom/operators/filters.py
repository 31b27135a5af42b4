"""Record filters."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import predicates
from ..functions.scalars import date_bounds


@dataclass(frozen=True)
class LogFilters:
    """What a caller may filter on; whatever is left unset adds nothing."""

    levels: list[str] = field(default_factory=list)
    services: list[str] = field(default_factory=list)
    environments: list[str] = field(default_factory=list)
    categories: list[str] = field(default_factory=list)
    start_date: str | int | datetime | None = None
    end_date: str | int | datetime | None = None
    search_text: str | None = None
    min_response_time: int | None = None
    max_response_time: int | None = None
    has_error: bool | None = None


def _within(
    start: str | int | datetime | None,
    end: str | int | datetime | None,
    partitioned: bool,
) -> list[Column]:
    conds = []
    if start:
        low = date_bounds(start)[0]
        conds.append(F.col("timestamp") >= F.lit(low))
        if partitioned:
            conds.append(F.col("log_date") >= F.lit(low.date()))
    if end:
        # first instant after the bound: inclusive at the bound's own precision
        after = date_bounds(end)[1]
        conds.append(F.col("timestamp") < F.lit(after))
        if partitioned:
            last = (after - timedelta(microseconds=1)).date()
            conds.append(F.col("log_date") <= F.lit(last))
    return conds


def time_range(
    logs: DataFrame,
    start: str | int | datetime | None = None,
    end: str | int | datetime | None = None,
) -> DataFrame:
    """Records from ``start`` to ``end``, both included.

    Where the table has a ``log_date`` partition column the bounds are repeated
    on it, so that only the days in question are read.
    """
    conds = _within(start, end, "log_date" in logs.columns)
    return logs.where(reduce(Column.__and__, conds)) if conds else logs


def last_days(logs: DataFrame, days: int, as_of: str | int | datetime) -> DataFrame:
    """Records of the ``days`` days up to ``as_of``, both ends included."""
    end = date_bounds(as_of)[0]
    return time_range(logs, end - timedelta(days=days), end)


def predicates_for(filters: LogFilters, partitioned: bool = False) -> list[Column]:
    """One column per filter that is set; the text search is not among them."""
    conds = _within(filters.start_date, filters.end_date, partitioned)
    for path, allowed in (
        ("level", filters.levels),
        ("service.name", filters.services),
        ("service.environment", filters.environments),
        ("category", filters.categories),
    ):
        if allowed:
            conds.append(F.col(path).isin(list(allowed)))
    # a bound of 0 counts as not given
    if filters.min_response_time:
        conds.append(F.col("metrics.response_time_ms") >= filters.min_response_time)
    if filters.max_response_time:
        conds.append(F.col("metrics.response_time_ms") <= filters.max_response_time)
    if filters.has_error is not None:
        has = predicates.error_exists()
        conds.append(has if filters.has_error else ~has)
    return conds


def apply_filters(logs: DataFrame, filters: LogFilters | None) -> DataFrame:
    """Every filter but the text search, as one conjunction."""
    conds = predicates_for(filters, "log_date" in logs.columns) if filters else []
    return logs.where(reduce(Column.__and__, conds)) if conds else logs


def lookup(logs: DataFrame, log_id: str, day: str | None = None) -> DataFrame:
    """The record with this id, or no row.

    On the written table the Bloom filters on ``id`` spare the files without it;
    a known ``day`` spares all other partitions.
    """
    if day is not None and "log_date" in logs.columns:
        logs = logs.where(F.col("log_date") == F.lit(day).cast("date"))
    return logs.where(F.col("id") == log_id)


def slow_requests(logs: DataFrame, at_least_ms: int = 2000) -> DataFrame:
    return logs.where(F.col("metrics.response_time_ms") >= at_least_ms)


def missing_timestamp(logs: DataFrame) -> DataFrame:
    return logs.where(predicates.missing("timestamp"))


def fatal_logs(logs: DataFrame) -> DataFrame:
    return logs.where(F.col("level") == "fatal")


def project(logs: DataFrame, paths: list[str]) -> DataFrame:
    """Keep only these (nested) fields, in their nested shape."""
    tree: dict = {}
    for path in paths:
        node = tree
        for part in path.split("."):
            node = node.setdefault(part, {})

    def build(node: dict, prefix: str) -> list[Column]:
        out = []
        for name, children in node.items():
            path = f"{prefix}.{name}" if prefix else name
            if children:
                # an absent object stays absent
                shaped = F.when(F.col(path).isNotNull(), F.struct(*build(children, path)))
                out.append(shaped.alias(name))
            else:
                out.append(F.col(path).alias(name))
        return out

    return logs.select(*build(tree, ""))
