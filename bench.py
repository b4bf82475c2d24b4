"""Times the headline queries: one JSON line, seconds per query and in total.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose the data and cores.
Each query is planned and run in full into a sink that discards its rows.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "group_summary", "group_compare_two", "seasonal_pattern", "top_combinations",
    "multi_criteria_rank", "efficiency_rank", "threshold_analysis", "compound_filter",
    "segment_comparison", "null_profile", "cardinality", "numeric_stats", "iqr_outliers",
    "histogram", "top_values", "duplicate_count", "correlation_pairs", "shape_stats", "pareto",
    "factor_influence", "monthly_trend", "period_growth", "linear_forecast", "impute_median",
    "modes", "flag_outliers", "drop_duplicates", "activity_rollup", "tokens", "holt_forecast_by_region",
]


def main() -> None:
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    from assay.plans.catalog import QUERIES
    from assay.session import local_session
    spark = local_session(cpus, partitions=cpus)
    # the JVM's start and first compilations are not part of any query
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet")
    nations.groupBy("n_regionkey").count().join(nations, "n_regionkey").orderBy("n_name").collect()
    seconds: dict[str, float] = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    found = re.search(r"sf([\d.]+)$", sf_dir)
    print(json.dumps({
        "metric": "total seconds of the headline queries", "value": round(sum(seconds.values()), 3),
        "unit": "sec", "queries": seconds, "sf": float(found.group(1)) if found else sf_dir,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
