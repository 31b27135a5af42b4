"""Boilerplate lines by their frequency within a site.

For each host: the number of its pages, and for each line the number of pages
that hold it. A line on more than ``ratio`` of the pages of its host, and on ``min_pages`` at
least, is boilerplate there and dropped from these pages; on other hosts it stays.

Only line digests are shuffled for counting, and Spark's partial aggregation folds
a common line of a large host within each task. The boilerplate of a host holds
at most (mean number of different lines on a page) / ``ratio`` digests, because every such line
fills more than that share of the pages; so it fits into one row, which
is joined to the pages. While hosts and digests are few, counted first, they are broadcast and no page is shuffled; beyond that a large
host is a hot key of that join only, which AQE splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, rest, small, stored

RATIO = 0.5
#: A line is judged from two pages on: on a host with one page every line has the ratio 1.
MIN_PAGES = 2
_BLANK = r"[\x09-\x0D\x20]+"


def host_of(url: Column) -> Column:
    """The host of an address in lower case; empty where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)", 1), F.lit("")))


def html_lines(html: Column) -> Column:
    """Markup as text lines: scripts, styles, comments and tags become line ends."""
    for pattern in (r"(?is)<script.*?</script>", r"(?is)<style.*?</style>", r"(?s)<!--.*?-->", r"<[^>]*>"):
        html = F.regexp_replace(html, pattern, "\n")
    return html


def _lines(text: Column) -> Column:
    parts = F.transform(
        F.split(F.coalesce(text, F.lit("")), "\n"),
        lambda x: F.regexp_replace(x, rf"^{_BLANK}|{_BLANK}$", ""),
    )
    return F.filter(parts, lambda x: x != "")


def _digest(line: Column) -> Column:
    return F.unhex(F.md5(line))


def line_dedup(
    pages: DataFrame, page_id: str, host: Column, text: Column,
    ratio: float = RATIO, min_pages: int = MIN_PAGES,
) -> DataFrame:
    """Every page with ``host``, ``host_pages``, ``n_lines``, ``n_dropped`` and the ``text`` that is left.

    Lines are trimmed and empty ones left out. A null text has no lines and an
    empty result; pages with a null or empty host form the group ``""``. Every row counts as a page,
    repeated rows too. Lines in equal shares are treated alike: the rule is ``pages with the line > ratio *
    pages of the host``. The other columns of ``pages`` follow, but for those that clash.
    """
    out = ["host", "host_pages", "n_lines", "n_dropped", "text"]
    extra = rest(pages, [page_id, *out])
    base = pages.select(
        col(page_id).alias("_page"), F.coalesce(host, F.lit("")).alias("_host"), _lines(text).alias("_lines"),
        *(col(c).alias(f"_x{i}") for i, c in enumerate(extra)),
    )
    totals = base.groupBy("_host").agg(F.count(F.lit(1)).alias("_pages"))
    counts = (
        base.select("_host", F.explode(F.array_distinct(F.transform("_lines", _digest))).alias("_line"))
        .groupBy("_host", "_line").agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") >= min_pages)
    )
    common = (
        counts.join(totals, "_host").where(F.col("_n") > F.col("_pages") * F.lit(float(ratio)))
        .groupBy("_host").agg(F.collect_list("_line").alias("_common"))
    )
    sites = stored(totals.join(common, "_host", "left"), "sites")
    n_sites, n_lines = sites.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("_common")), F.lit(0))).first()
    kept = F.when(F.col("_common").isNull(), F.col("_lines")).otherwise(
        F.filter("_lines", lambda x: ~F.array_contains("_common", _digest(x)))
    )
    return (
        base.join(small(sites, n_sites + max(n_lines, 0)), "_host")
        .withColumn("_kept", kept)
        .select(
            F.col("_page").alias(page_id), F.col("_host").alias("host"), F.col("_pages").alias("host_pages"),
            F.size("_lines").alias("n_lines"), (F.size("_lines") - F.size("_kept")).alias("n_dropped"),
            F.array_join("_kept", "\n").alias("text"),
            *(F.col(f"_x{i}").alias(c) for i, c in enumerate(extra)),
        )
    )
