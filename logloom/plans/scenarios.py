"""The four ingestion scenarios and the queries each one runs."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregates, filters, histogram, paging, search
from ..sources import synthetic, tables

Query = Callable[[DataFrame], DataFrame]


def slow_request_search(logs: DataFrame) -> DataFrame:
    paths = [
        "id", "timestamp", "service.name", "request.path", "metrics.response_time_ms", "level"
    ]
    return filters.project(paging.slowest(filters.slow_requests(logs), 5), paths)


def failed_documents(logs: DataFrame) -> DataFrame:
    """Fatal records to follow up; refused documents are in the rejects table."""
    paths = [
        "id", "timestamp", "service.name", "level", "message", "error.type", "error.message"
    ]
    return filters.project(filters.fatal_logs(logs).orderBy("id").limit(5), paths)


def missing_timestamps(logs: DataFrame) -> DataFrame:
    return aggregates.total(filters.missing_timestamp(logs))


# The query texts, and below the ids, suffixes and sizes of the scenarios.
MATCH = "payment gateway timeout error"
PHRASE = "inventory synchronization delayed"
TYPO = "user authentikation succesful"


def match_search(logs: DataFrame) -> DataFrame:
    hits = search.match(logs, MATCH).orderBy(*search.by_score()).limit(5)
    return search.query_highlight(hits, MATCH).select(
        "id", "score", "message", "tags", "highlight"
    )


def phrase_search(logs: DataFrame) -> DataFrame:
    hits = search.match_phrase(logs, PHRASE, 2).orderBy(*search.by_score()).limit(5)
    return search.query_highlight(hits, PHRASE).select("id", "score", "message", "highlight")


def fuzzy_search(logs: DataFrame) -> DataFrame:
    found = search.multi_match(logs, TYPO, [search.MESSAGE, search.TAGS], keep_terms=True)
    hits = found.orderBy(*search.by_score()).limit(5)
    return search.with_highlight(hits, {"message": F.col("message_matched")}).select(
        "id", "score", "message", "tags", "highlight"
    )


@dataclass(frozen=True)
class Scenario:
    id: str
    suffix: str
    total: int
    batch_size: int
    profile: Callable[[DataFrame], DataFrame] | None
    queries: dict[str, Query]


SCENARIOS = {
    s.id: s
    for s in [
        Scenario(
            "massive-bulk",
            "massive",
            500_000,
            5_000,
            None,
            {
                "level distribution": aggregates.level_distribution,
                "top services": aggregates.top_services,
                "response time percentiles": lambda logs: aggregates.percentiles(
                    logs, "metrics.response_time_ms"
                ),
            },
        ),
        Scenario(
            "query-diversity",
            "queries",
            200_000,
            2_500,
            synthetic.diverse,
            {
                "error rate by environment": aggregates.error_rate_by_environment,
                "slow requests": slow_request_search,
                "time series": lambda logs: histogram.time_series(logs, "2h"),
            },
        ),
        Scenario(
            "failure-recovery",
            "failure",
            100_000,
            2_000,
            synthetic.failing,
            {
                "missing timestamps": missing_timestamps,
                "fatal and error": lambda logs: aggregates.level_distribution(
                    logs, ["error", "fatal"]
                ),
                "failed documents": failed_documents,
            },
        ),
        Scenario(
            "search-experiments",
            "search",
            150_000,
            2_500,
            synthetic.search_profile,
            {
                "match": match_search,
                "phrase": phrase_search,
                "fuzzy": fuzzy_search,
            },
        ),
    ]
}


def records(
    spark: SparkSession, scenario: Scenario, base_date: str | date, total: int | None = None
) -> DataFrame:
    rows = synthetic.generate(spark, total or scenario.total, str(base_date))
    if scenario.profile is not None:
        rows = rows.transform(scenario.profile)
    return synthetic.finish(rows)


def run(
    spark: SparkSession,
    scenario_id: str,
    path: str,
    base_date: str | date,
    total: int | None = None,
    prefix: str = "logs",
    force: bool = False,
) -> dict[str, DataFrame]:
    """Ingest a scenario's records into the table at ``path`` and plan its queries.

    The records form a family of their own, so the queries read them only.
    """
    return _run(spark, scenario_id, path, base_date, total, prefix, force)[0]


def _run(
    spark: SparkSession, scenario_id: str, path: str, base_date: str | date, total: int | None, prefix: str, force: bool
) -> tuple[dict[str, DataFrame], int]:
    """The planned queries, and how many rows the table has more of the scenario.

    Both counts come from the file footers of its family. With ``force`` it is all
    that the family has then.
    """
    scenario = SCENARIOS[scenario_id]
    family = f"{prefix}-{scenario.suffix}"
    below = f"{path}/family={family}"
    before = 0 if force or not tables.matches(spark, below) else tables.read_table(spark, below, path).count()
    tables.write_table(records(spark, scenario, base_date, total), path, family, force)
    logs = tables.read_table(spark, path).where(F.col("family") == family)
    return {name: query(logs) for name, query in scenario.queries.items()}, logs.count() - before


@dataclass(frozen=True)
class Outcome:
    """What became of one scenario: its planned queries, or the error that ended it."""

    scenario: str
    queries: dict[str, DataFrame]
    inserted: int
    duration_ms: int
    error: str | None = None

    @property
    def rate(self) -> float:
        """Records per second."""
        return self.inserted * 1000 / max(1, self.duration_ms)


def run_all(
    spark: SparkSession,
    path: str,
    base_date: str | date,
    ids: Iterable[str] | None = None,
    total: int | None = None,
    prefix: str = "logs",
    force: bool = False,
) -> list[Outcome]:
    """Run several scenarios one after another; one that fails does not stop the rest."""
    out = []
    for scenario_id in ids or SCENARIOS:
        start = time.time()
        try:
            planned, inserted = _run(spark, scenario_id, path, base_date, total, prefix, force)
            error = None
        except Exception as e:  # noqa: BLE001 - reported with the scenario
            planned, inserted, error = {}, 0, f"{type(e).__name__}: {e}"
        spent = int((time.time() - start) * 1000)
        out.append(Outcome(scenario_id, planned, inserted, spent, error))
    return out
