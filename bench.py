"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR   tables to read (default /root/testdata/sf0.1)
BENCH_CPUS     local cores (default 8)
BENCH_QUERIES  comma-separated names, or 'all'; default: the headline list below

Every query runs twice, each time to the end (all rows produced, none kept); the better time counts.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lakegauge.session import local_session  # noqa: E402
from workload import QUERIES  # noqa: E402

HEADLINE = (
    "column_profile", "column_distinct_approx", "table_metrics", "table_scores", "column_scores", "row_uniqueness",
    "key_uniqueness", "rule_suite", "rule_violation_counts", "referential_integrity", "cross_table_order",
    "star_final_score", "heuristic_scores", "g3_dimension_scores", "run_kpis", "score_history", "run_comparison",
    "attention_columns", "dataset_score_history", "prioritized_recommendations", "parse_datetime", "parse_ptbr_number",
    "csv_scan", "inbox_incremental", "scan_run",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if chosen == "all" else chosen.split(",") if chosen else list(HEADLINE)
    spark = local_session("bench", cpus, shuffle_partitions=int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy("o_orderstatus").count().collect()
    times = {}
    for name in names:
        best = None
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        times[name] = round(best, 3)
        print(f"{name} {best:.3f}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
