"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default all),
BENCH_QUERIES (comma separated, or ``all``) and BENCH_RUNS (default 2; the
best run counts) choose what runs.  Results go to Spark's ``noop`` sink, so
every row and column is computed and nothing is collected.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from flowtally.queries import QUERIES  # noqa: E402
from flowtally.session import build_session  # noqa: E402

HEADLINE = [
    "scd2_apply",
    "cdc_apply",
    "merge_upsert",
    "incremental_load",
    "late_arrival_scd2",
    "preset_dedup",
    "billing_summary",
    "coalesce_patches",
    "request_counters",
    "snapshot_diff",
    "three_way_reconcile",
    "lineage_check",
    "check_transitions",
    "needs_rebuild",
    "impact_nodes",
    "impact_edges",
    "text_search",
    "json_diff",
    "json_diff_nested",
    "extract_spec",
    "dq_all_rules_in_one_pass",
    "dq_check_duplicates",
    "risk_plan",
    "decide_execution",
    "apply_commands",
    "rate_limit",
    "budget_admission",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    chosen = os.environ.get("BENCH_QUERIES", "")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    names = list(QUERIES) if chosen == "all" else chosen.split(",") if chosen else HEADLINE
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        {"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "12g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    times: dict[str, float] = {}
    for name in names:
        best = None
        for _ in range(max(1, runs)):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        times[name] = round(best, 3)
    print(
        json.dumps(
            {
                "metric": "headline_query_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
