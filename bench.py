"""Headline queries on one folder of tables; prints one JSON line.

BENCH_SF_DIR   folder of parquet tables (default /root/testdata/sf0.1)
BENCH_CPUS     local cores (default 8)
BENCH_QUERIES  comma-separated names instead of the headline list
"""

from __future__ import annotations

import json
import os
import time

HEADLINE = [
    "exceedance_table", "clean_measurements", "describe_by_site", "equivalent_levels", "site_table", "video_match",
    "disc_morphology", "neighbour_counts", "road_density", "road_distances", "eight_nearest", "noise_ceiling",
    "line_crossings", "video_counts", "hours_filled", "buffered_means", "block_fold_means", "bootstrap_intervals",
    "scenario_indicators", "grid_prediction",
]


def main() -> None:
    from soundfield.plans import QUERIES
    from soundfield.session import local_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    names = os.environ.get("BENCH_QUERIES")
    spark = local_session(cores, "bench")
    spark.range(1000).selectExpr("sum(id)").collect()  # start executors before the first clock
    times: dict[str, float] = {}
    for name in names.split(",") if names else HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
