"""Time the headline queries: one warm-up, then the median of three runs each, forced by a noop write.

Prints one JSON line. BENCH_SF_DIR, BENCH_CPUS and BENCH_RUNS may be set.
"""

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from rotorwatch.plans.registry import QUERIES  # noqa: E402
from rotorwatch.session import build_session  # noqa: E402

HEADLINE = [
    "silver_sensor", "silver_logs", "anomaly_flags", "hourly_trends", "trend_slope", "gold_health",
    "gold_cost", "rolling_vibration", "rolling_median", "ewma", "consecutive_over", "thermal_spike",
    "mtbf_by_asset", "days_since_prev", "maintenance_history", "ftf_by_technician", "repair_averages",
    "cost_summary", "health_board", "trend_recent", "search_manuals", "search_failure_patterns",
    "vector_top_k", "chunk_markdown", "provenance_explode", "sink_upsert_health",
    "sink_upsert_keyed", "sink_upsert_keyed_1pct",
    "sink_insert_disruption", "serial_ids", "pm_due", "asset_dossier",
]


def main():
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false",
           "spark.ui.showConsoleProgress": "false", "spark.python.sql.dataFrameDebugging.enabled": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")

    def once(build):
        start = time.perf_counter()
        build(spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    wanted = sys.argv[1:] or HEADLINE
    times = {}
    for key in wanted:
        once(QUERIES[key])
        times[key] = round(statistics.median(once(QUERIES[key]) for _ in range(runs)), 3)
        print(key, times[key], file=sys.stderr)
    print(json.dumps({
        "metric": "sum of median seconds over headline queries", "value": round(sum(times.values()), 3),
        "unit": "sec", "queries": times, "sf": Path(folder).name.removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
