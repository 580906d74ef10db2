"""Benchmark the headline queries.

Runs each query to completion with the ``noop`` sink (full execution, no
driver collection) on ``local[$BENCH_CPUS]`` over ``$BENCH_SF_DIR`` and prints
one JSON line: {"metric", "value" (total seconds), "unit", "queries", "sf"}.
Each query is built and run ``$BENCH_REPEATS`` times (default 2), with all
caches cleared before each run; "queries" has its best time, which damps JIT
warm-up and VM noise, and "first" the time of its first run.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "win01_robust_anomalies", "agg05_facility_median_mad", "agg01_daily_emissions", "agg02_gapfilled_daily",
    "agg03_hourly_energy", "agg11_period_stats", "join04_combined_metrics", "win07_current_per_facility",
    "win02_lag_features", "win03_rolling_features", "win08_time_linear_interpolation", "win09_training_windows",
    "val01_02_emission_rejects", "val09_step_mode_global", "prj01_02_co2e_intensity", "join05_validity_dated_factor",
    "flt09_iqr_global", "ml01_iqr_capping", "ml04_standard_scaling", "agg08_histogram", "agg16_drift_aligned",
    "srt01_page", "snk01_join07_insert_ignore", "snk06_audit_trail", "led01_balances", "led03_overdraft_screen",
    "led07_srt04_join09_statement", "str04_tumbling_daily_totals",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = [a for a in sys.argv[1:]]
    from pyspark.sql import SparkSession
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("verdigris-bench")
             .config("spark.sql.shuffle.partitions", str(max(8, 2 * int(cpus))))
             .config("spark.sql.adaptive.enabled", "true")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "16g"))
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    from verdigris.plans.catalog import entries
    from verdigris.session import checkpoint_dir
    checkpoint_dir(spark)
    reg = entries()
    names = [n for n in HEADLINE if not only or n in only]
    # Warm-up: one untimed pass of the first headline query on the smallest
    # scale, so JIT/codegen start-up is not billed to whichever query runs first.
    warm_dir = os.environ.get("BENCH_WARMUP_DIR", "/root/testdata/sf0.001")
    if os.path.isdir(warm_dir):
        reg[names[0]].build(spark, warm_dir).write.format("noop").mode("overwrite").save()
    repeats = max(1, int(os.environ.get("BENCH_REPEATS", "2")))
    times, first = {}, {}
    for n in names:
        runs = []
        for _ in range(repeats):
            spark.catalog.clearCache()
            t0 = time.perf_counter()
            reg[n].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - t0)
        times[n], first[n] = round(min(runs), 3), round(runs[0], 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "first": first, "first_total": round(sum(first.values()), 3), "sf": float(m.group(1)) if m else None}))
    spark.stop()


if __name__ == "__main__":
    main()
