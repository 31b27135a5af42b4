"""Order, pages and top-k."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Page:
    """One page of records. ``rows`` and ``info`` are both lazy."""

    rows: DataFrame
    info: DataFrame  # total, has_next_page, has_previous_page


def check_page(limit: int, offset: int) -> None:
    if limit < 0 or offset < 0:
        raise ValueError("limit and offset must not be negative")


def newest_first() -> list[Column]:
    """Records without a timestamp come last; the id settles ties."""
    return [F.col("timestamp").desc_nulls_last(), F.col("id").asc()]


def page_rows(
    logs: DataFrame, limit: int = 20, offset: int = 0, order: list[Column] | None = None
) -> DataFrame:
    check_page(limit, offset)
    # order + offset + limit is one TakeOrderedAndProject: each task keeps at
    # most offset + limit rows, no full sort happens
    return logs.orderBy(*(order or newest_first())).offset(offset).limit(limit)


def page_info(logs: DataFrame, limit: int = 20, offset: int = 0) -> DataFrame:
    """Exact total and the two page flags, one row."""
    return logs.agg(F.count(F.lit(1)).alias("total")).select(
        "total",
        (F.lit(offset + limit) < F.col("total")).alias("has_next_page"),
        F.lit(offset > 0).alias("has_previous_page"),
    )


def page(
    logs: DataFrame, limit: int = 20, offset: int = 0, order: list[Column] | None = None
) -> Page:
    return Page(page_rows(logs, limit, offset, order), page_info(logs, limit, offset))


def slowest(logs: DataFrame, n: int = 5) -> DataFrame:
    return logs.orderBy(
        F.col("metrics.response_time_ms").desc_nulls_last(), F.col("id").asc()
    ).limit(n)


def top_tables(stats: DataFrame, n: int = 10) -> DataFrame:
    """The largest tables by size."""
    return stats.orderBy(F.col("size_bytes").desc(), F.col("name").asc()).limit(n)
