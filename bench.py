"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import time

from siftlake.plans.suite import QUERIES
from siftlake.session import local_session

HEADLINE = [
    "scan_documents",
    "scan_documents_pack",
    "scan_pages_pack",
    "scan_conversations_pack",
    "scan_seeded",
    "scan_many_rules",
    "score_seeded",
    "low_scores",
    "full_scores",
    "gate_outcome",
    "json_report",
    "sarif_logs",
    "text_report",
    "lint_ruff",
    "lint_clippy",
    "pack_rules",
    "changed_scan",
    "request_bodies",
    "stream_scan",
    "stream_latest",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cores)

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    # The first run of a query also times the JVM compiling it; the second is the steady state.
    first = {name: run(name) for name in HEADLINE}
    seconds = {name: min(first[name], run(name)) for name in HEADLINE}
    total = round(sum(seconds.values()), 3)
    sf = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "first_run": first, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
