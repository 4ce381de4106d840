"""Time the headline queries; print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) select
the data and the local cores. BENCH_QUERIES may name a comma-separated subset.
Every query runs to completion into a sink that discards its rows.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from plumbline.catalog import all_entries  # noqa: E402
from plumbline.session import local_session  # noqa: E402

HEADLINE = [
    "ranking_metrics",
    "ranking_by_region",
    "ranking_per_sample",
    "risk_coverage_curve",
    "calibration_summary",
    "evaluate_condition_splits",
    "evaluate_temperatures",
    "fit_scopes",
    "region_calibration",
    "score_local_disagreement",
    "apply_condition",
    "near_dup_candidates",
    "connected_components",
    "exclusions",
    "grouped_split",
    "select_balanced_split",
    "validate_protocol",
    "paired_bootstrap",
    "clustered_bootstrap",
    "calibration_stream",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    entries = all_entries()
    entries["quality_columns"][0](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        entries[name][0](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": Path(folder).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()
