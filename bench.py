"""Headline queries at one scale on one machine: prints one JSON line.

Each query is written to a sink that reads every row and keeps none. The time is that of the second run in a warm session,
plan building included.
"""

from __future__ import annotations

import contextlib
import json
import os
import sys
import time

from pressroom.plans import QUERIES
from pressroom.session import local_session

HEADLINE = (
    "corpus_summary",
    "extracted_articles",
    "main_texts",
    "element_counts",
    "resolve_links",
    "url_normalize",
    "url_reject_reasons",
    "allowlist_semi",
    "first_occurrence",
    "batch_intake",
    "clean_texts",
    "word_gate",
    "parse_times",
    "normalize_requests",
    "classify_dates",
    "date_reports",
    "reports_by_month",
    "job_counts",
    "job_details",
    "recent_job_list",
    "search_progress",
    "politeness",
    "politeness_in_ranges",
    "redirect_chains",
    "robots_gates",
    "repeat_cutoff",
    "discover_urls",
    "advance_budget",
    "backlog_order",
    "upsert_rows",
    "all_metrics",
    "stream_item_outcomes",
)


def run(spark, folder: str, name: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4)))
    only = sys.argv[1:]
    seconds = {}
    with contextlib.redirect_stdout(sys.stderr):
        spark = local_session(cpus)
        for name in HEADLINE:
            if only and name not in only:
                continue
            run(spark, folder, name)
            seconds[name] = round(run(spark, folder, name), 3)
            print(name, seconds[name], flush=True)
        spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "cpus": cpus,
            }
        )
    )


if __name__ == "__main__":
    main()
