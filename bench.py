"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is run once to warm up and then timed three times ($BENCH_RUNS), of which the median counts; the result is written to the
"noop" sink, so every output row is computed and nothing is collected.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from acreline.queries import REGISTRY

HEADLINES = (
    "matched_growth_index", "matched_growth", "assembled_panel", "apply_changes_until_next",
    "permit_features", "assessor_permit_features", "exemption_features", "inspection_features",
    "change_log", "value_history", "residential_snapshot", "commercial_snapshot",
    "condo_snapshot", "classified_parcels", "dominant_use", "category_vote", "median_by_type",
    "carry_forward_in_log", "running_sum_in_log", "top_n_per_group", "normalize_text",
    "published_rates", "routed_rates", "sequential_forecast", "residual_forecast",
    "aggregate_forecast", "compounded_forecast", "scenario_summary", "trajectory",
    "retrofitted_panel", "holdout_evaluation",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.sql.shuffle.partitions", cpus)
             .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
             .config("spark.ui.enabled", "false")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.perf_counter()
        REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    timings = {}
    for name in HEADLINES:
        run(name)
        timings[name] = round(statistics.median(run(name) for _ in range(runs)), 3)
    print(json.dumps({
        "metric": "sum of warm query times", "value": round(sum(timings.values()), 3),
        "unit": "sec", "queries": timings, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
