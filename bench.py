"""Time the headline queries; print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Each query is written to the no-op sink, so every row is produced. The first
run warms the JVM up; the better of two timed runs counts.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from dispatchlake.queries import ALL  # noqa: E402

HEADLINE = [
    "minute_metrics",
    "screen_flow",
    "dispatch_flow",
    "rate_limit",
    "sliding_success",
    "correlate",
    "latest_status",
    "attempt_chain",
    "customer_month_docs",
    "route_results",
    "retry_plan",
    "latency_histogram",
    "reconcile",
    "sms_body_bytes",
    "stream_dedup",
    "stream_minute_metrics",
    "stream_retry",
    "stream_hold_until_due",
    "stream_rate_limit",
    "settle_flow",
    "assign_sequence",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("dispatchlake-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        # tables are a few MB here: keep all cores busy after a shuffle
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128k")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    n_events = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    seconds = {}
    for name in names:
        times = []
        for _ in range(3):
            began = time.perf_counter()
            ALL[name][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        seconds[name] = round(min(times[1:]), 3)
    total = round(sum(seconds.values()), 3)
    slowest = max(seconds.values())
    print(
        json.dumps(
            {
                "metric": "headline queries, total seconds",
                "value": total,
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "events": n_events,
                "events_per_second_slowest": round(n_events / slowest),
                "target_messages_per_second": 2000,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
