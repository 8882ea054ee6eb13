"""Benchmark: seconds per query at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm the JVM and once timed; all result rows are produced (noop sink)."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "asof_backward", "asof_multi_anchor", "resample_ffill", "sessionize_gaps", "ladder_shape", "book_walk", "participant_pnl",
    "parameter_sweep", "feature_matrix", "dq_bounds", "join_full_outer_diff",
)


def main() -> None:
    from vaneflow.catalog import load
    from vaneflow.catalog.registry import runnable
    from vaneflow.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    load()
    spark = build_session(f"local[{cpus}]", int(cpus))
    seconds = {}
    for name in names:
        for _ in range(2):
            start = time.perf_counter()
            runnable(name)(spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "total_query_seconds", "value": total, "unit": "sec", "queries": seconds, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))
    spark.stop()


if __name__ == "__main__":
    main()
