"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs twice; the first run (JIT, footers) is dropped and the median of
the rest is reported.  BENCH_RUNS overrides the number of runs.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from tracksieve.plans.registry import all_queries
from tracksieve.session import get_session

HEADLINE = (
    "causal_windows", "sweep_counts", "asof_blocking", "interval_stats", "value_stats", "gap_runs_fixed", "eligibility_manifest",
    "authorise_reads", "dist_nearest_rank", "split_allocation", "paired_contrasts", "bootstrap_ci",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = get_session("bench", cores)
    found = all_queries()
    seconds = {}
    for name in HEADLINE:
        times = []
        for _ in range(runs):
            start = time.time()
            found[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.time() - start)
        seconds[name] = round(statistics.median(times[1:] or times), 3)
    spark.stop()
    print(json.dumps({
        "metric": "headline_total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
