"""The five queries of the log API."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import paging, search
from ..operators.filters import LogFilters, apply_filters, lookup
from .dashboard import log_aggregations as _aggregations


def _found(
    logs: DataFrame,
    filters: LogFilters | None,
    keep_terms: bool = False,
    statistics: DataFrame | None = None,
) -> DataFrame:
    """Filtered rows; with a search text also scored. Term statistics are those
    of all ``logs``, whatever the filters leave; written ones spare a scan."""
    rows = apply_filters(logs, filters)
    if filters and filters.search_text:
        return search.multi_match(
            rows, filters.search_text, scope=logs, keep_terms=keep_terms, statistics=statistics
        )
    return rows


def logs(
    df: DataFrame,
    filters: LogFilters | None = None,
    limit: int = 20,
    offset: int = 0,
    statistics: DataFrame | None = None,
) -> paging.Page:
    """Matching records, newest first."""
    found = _found(df, filters, statistics=statistics)
    return paging.page(found.drop("score"), limit, offset)


def log(df: DataFrame, log_id: str) -> DataFrame:
    """One record by id, or no row."""
    return lookup(df, log_id)


def log_aggregations(
    df: DataFrame,
    filters: LogFilters | None = None,
    interval: str = "1h",
    statistics: DataFrame | None = None,
) -> DataFrame:
    """Counts by level and service, the time series, and the total."""
    return _aggregations(_found(df, filters, statistics=statistics), interval)


def similar_logs(
    df: DataFrame, log_id: str, limit: int = 10, statistics: DataFrame | None = None
) -> DataFrame:
    """Records like the given one, best first, with ``score``."""
    paging.check_page(limit, 0)
    found = search.more_like_this(df, log_id, statistics=statistics)
    return found.orderBy(*search.by_score(None)).limit(limit)


def search_logs(
    df: DataFrame,
    query: str,
    filters: LogFilters | None = None,
    limit: int = 20,
    offset: int = 0,
    statistics: DataFrame | None = None,
) -> paging.Page:
    """Typo-tolerant search within the filters: best first, then newest.

    ``query`` takes the place of a search text in the filters; an empty query
    leaves only the filters. Rows carry ``score`` and ``highlight``.
    """
    asked = replace(filters or LogFilters(), search_text=query)
    found = _found(df, asked, keep_terms=True, statistics=statistics)
    if not query:
        found = found.withColumn("score", F.lit(1.0))
    rows = paging.page_rows(found, limit, offset, search.by_score())
    matched = {
        f.path: F.col(name)
        for f in search.SEARCH_FIELDS
        if (name := f.path.replace(".", "_") + "_matched") in found.columns
    }
    if matched:
        rows = search.with_highlight(rows, matched).drop(
            *[p.replace(".", "_") + "_matched" for p in matched]
        )
    return paging.Page(rows, paging.page_info(found, limit, offset))
