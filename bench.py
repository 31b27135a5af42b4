"""Time the headline queries; prints one JSON line.

Each query runs to its last row (a ``noop`` write), so nothing is pruned away as
a count would allow. The log queries read a log table written from the events
beforehand, as a user's would, with the analyzed terms stored; writing it is a
query of its own.
"""

from __future__ import annotations

import json
import os
import sys
import time
import uuid

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from pyspark.sql import functions as F  # noqa: E402

from contract.ingest_queries import raw_lines  # noqa: E402
from logloom.operators import aggregates as A  # noqa: E402
from logloom.operators import histogram as H  # noqa: E402
from logloom.operators import metrics as M  # noqa: E402
from logloom.operators import paging as P  # noqa: E402
from logloom.operators import postings as PO  # noqa: E402
from logloom.operators import search as S  # noqa: E402
from logloom.operators.filters import LogFilters, apply_filters  # noqa: E402
from logloom.plans import api, dashboard  # noqa: E402
from logloom.session import build_session, checkpoint_dir  # noqa: E402
from logloom.sources import synthetic, tables, validation  # noqa: E402
from logloom.sources.events import (  # noqa: E402
    load_documents,
    load_events,
    load_logs,
    logs_from_events,
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "logloom-bench",
        f"local[{cpus}]",
        int(cpus) if cpus.isdigit() else 8,
        {
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    path = f"{checkpoint_dir(spark)}/bench-{uuid.uuid4().hex}"
    text = S.TextField("text")
    plain = S.TextField("text", stem=False)
    timings: dict[str, float] = {}

    def timed(name, action) -> None:
        start = time.time()
        action()
        timings[name] = round(time.time() - start, 3)

    def run(name, make) -> None:
        timed(name, lambda: make().write.format("noop").mode("overwrite").save())

    # each test table is one file with one row group, which one task would read
    cores = spark.sparkContext.defaultParallelism
    events = load_events(spark, sf_dir).repartition(cores)
    load_logs(spark, sf_dir).agg(F.count("id")).collect()  # start the JVM's engine
    records = logs_from_events(events)
    timed("write_table", lambda: tables.write_table(S.store_terms(records), path))
    logs = tables.read_table(spark, path)
    docs = load_documents(spark, sf_dir).repartition(cores)
    combo = LogFilters(
        levels=["info", "warn", "error"],
        environments=["production"],
        start_date="2024-01-05",
        end_date="2024-01-25",
        min_response_time=200,
    )

    run("dashboard_30d", lambda: dashboard.fetch_analytics(logs, 30, "2024-01-31"))
    run("log_aggregations", lambda: api.log_aggregations(logs, combo))
    run("filter_page", lambda: P.page_rows(apply_filters(logs, combo), 20, 100))
    run("top_services", lambda: A.top_services(logs))
    run("env_error_rate", lambda: A.error_rate_by_environment(logs))
    run("percentiles", lambda: A.percentiles(logs, "metrics.response_time_ms"))
    run("p95_index", lambda: A.p95(logs, "metrics.response_time_ms"))
    run("hist_2h", lambda: H.time_series(logs, "2h"))
    run("metrics_snapshot", lambda: M.snapshot(M.merge(M.partials(logs))))
    run("search_logs", lambda: api.search_logs(logs, "databse connecton timout", combo).rows)
    timed("write_index", lambda: PO.write(logs, f"{path}-index"))
    index = PO.Index.read(spark, f"{path}-index")
    found = lambda: PO.page(PO.multi_match(index, "databse connecton timout"))
    run("search_index", lambda: PO.rows_of(logs, found(), named=True))
    run("similar_logs", lambda: api.similar_logs(logs, "96"))
    run("validate", lambda: validation.validate(raw_lines(events)))
    run("analyze", lambda: docs.select("doc_id", text.terms().alias("terms")))
    run("match_docs", lambda: S.match(docs, "reth anthe tion", plain, "or"))
    run("phrase_docs", lambda: S.match_phrase(docs, "de la", 2, plain))
    run("fuzzy_docs", lambda: S.multi_match(docs, "tionhe reth anthe", [plain]))
    run("like_docs", lambda: S.more_like_this(docs, F.lit(3), [plain], "doc_id", None))
    run("synthetic_500k", lambda: synthetic.finish(synthetic.generate(spark, 500_000, "2024-01-01")))

    name = os.path.basename(os.path.normpath(sf_dir))
    scale = name[2:] if name.startswith("sf") else name
    print(
        json.dumps(
            {
                "metric": "log analytics headline queries, total time",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
