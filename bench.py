"""Timed headline queries; prints one JSON line.

``BENCH_SF_DIR`` (default sf0.1), ``BENCH_CPUS`` (default 8), ``BENCH_RUNS`` (default 2).
Each query runs once to warm up; the median of the timed runs is reported. A run
covers building the plan and computing every output column.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from riskflow.plans.queries import QUERIES
from riskflow.session import local_session

HEADLINE = [
    "url_normalize", "url_flags", "url_scored", "verdict_counts", "text_signals", "text_normalize",
    "redact_text", "html_to_text", "url_extract", "header_signals", "sender_rules",
    "attachment_rules", "fuse_verdict", "triage_verdict", "feedback_metrics", "history_page",
    "ttl_dedup", "admission_server", "scan_verdicts",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    only = os.environ.get("BENCH_QUERIES")
    spark = local_session(cpus, "riskflow-bench")
    times: dict[str, float] = {}
    for name in only.split(",") if only else HEADLINE:
        taken = []
        for i in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            if i:
                taken.append(time.perf_counter() - start)
        times[name] = round(statistics.median(taken), 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"),
                "cpus": cpus,
                "runs": runs,
            }
        )
    )


if __name__ == "__main__":
    main()
