"""Time the headline queries on ``$BENCH_SF_DIR`` and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "flow_filled_hours", "flow_window_features", "window_sliding", "rolling_rows", "rolling_time", "rolling_quantiles",
    "join_asof", "join_era_progress", "segment_islands", "segment_runs", "impute_time_inside", "impute_conservative",
    "agg_hourly", "agg_ext_stats", "clean_iqr", "features_efficient", "complexity_acf", "complexity_permutation_entropy",
    "spectral_features", "stress_windows", "energy_windows", "changepoint_bocpd", "pareto_hypervolume",
]


def main() -> None:
    from tidegrid.plans.registry import spark_queries
    from tidegrid.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench")
    spark.sparkContext.setLogLevel("OFF")
    queries, times, rows = spark_queries(), {}, {}
    names = sys.argv[1:] or HEADLINE
    for warm in (True, False):  # the second, warm run is reported
        for name in names:
            start = time.perf_counter()
            # the noop sink computes every column of every row, unlike count()
            df = queries[name](spark, sf_dir)
            df.write.format("noop").mode("overwrite").save()
            if not warm:
                times[name] = round(time.perf_counter() - start, 3)
    events = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    flow = times.get("flow_window_features")
    if flow:
        rows["flow_rows_per_s"] = round(events / flow)
    print(json.dumps({"metric": "headline queries, warm second run, total wall time", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                      "events": events, **rows}))


if __name__ == "__main__":
    main()
