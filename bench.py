"""Time the headline queries. Prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma-separated names, "all", or empty for the headline set).
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "screen",
    "preprocess_items",
    "match_wordlist",
    "match_category_counts",
    "find_exact",
    "find_exact_large",
    "find_regex",
    "normalize_collapse",
    "byte_grid_hash",
    "blocklist_lookup",
    "exact_duplicates",
    "near_duplicates",
    "image_inventory",
    "custom_scorer",
    "fuse",
    "fuse_long",
    "layer_contribution",
    "audit_by_agent",
    "state_events",
    "rescreen",
    "check_transitions",
    "latest_checkpoint",
    "request_response",
    "stream_screen",
    "stream_request_response",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("siftgate-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from siftgate.queries import QUERIES

    chosen = os.environ.get("BENCH_QUERIES", "")
    names = HEADLINE if not chosen else list(QUERIES) if chosen == "all" else chosen.split(",")
    # Start the JVM's and Python's workers outside the measurement.
    QUERIES["byte_grid_hash"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        begin = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - begin, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
