"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; print one JSON line.

Each query is executed to completion with Spark's ``noop`` sink (all rows produced, nothing
collected). The first query also pays JVM/session warm-up; the reported value is the sum.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    # first: derive the input tables from events once (stored for the session, as production tables are)
    "flight_view", "raw_sheet_view",
    "hourly_dow_stats", "delay_summary", "airline_performance", "best_times", "ops_cube",
    "clean_messy", "rolling_delay", "propagate_turnaround", "propagate_runway_congestion",
    "build_edges", "simulate_cascade", "network_metrics", "apply_weather", "revenue_moves",
    "greedy_slot_allocation", "allocate_runway_slots", "reschedule_recommendations",
    "anomaly_alerts", "prediction_risk_grid", "parse_queries",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE

    from tarmac.plans.registry import load_all
    from tarmac.session import local_session

    spark = local_session(cpus=cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", "16")), app="tarmac-bench")
    reg = load_all()
    times: dict[str, float] = {}
    for name in names:
        t0 = time.perf_counter()
        reg[name].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    sf = Path(sf_dir).name.replace("sf", "")
    print(json.dumps({"metric": "headline_total_wall", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))


if __name__ == "__main__":
    main()
