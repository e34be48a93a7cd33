"""Benchmark the headline queries.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Each query is run to completion with the no-op sink (every row computed,
nothing collected to the driver). Before timing, the same queries run once
on the smallest fixture (``BENCH_WARM_DIR``) to start the JVM's JIT and the
Python worker pool; timed runs then read the whole tables at ``BENCH_SF_DIR``.
Prints one JSON line: total seconds of the headline set plus per-query seconds.
``BENCH_ALL=1`` times every registered query instead.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["knn1", "hit_decision", "neighbor_pairs", "neighbor_counts", "cache_replay",
            "replay_metrics", "pii_redact", "pii_entities", "pii_counts", "metrics", "timeline",
            "latency_by_run", "traffic_by_minute", "event_feed", "cache_list", "session_load",
            "gateway_flow"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from cachescope.plans.queries import REGISTRY
    from cachescope.session import local_session

    spark = local_session("cachescope-bench", cores=cpus, shuffle_partitions=int(cpus) * 2,
                          driver_memory="24g")
    names = list(REGISTRY) if os.environ.get("BENCH_ALL") else [n for n in HEADLINE if n in REGISTRY]
    warm_dir = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
    for name in names:
        if os.path.isdir(warm_dir):
            REGISTRY[name](spark, warm_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        t0 = time.perf_counter()
        REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf, "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
