"""Headline-query benchmark.

Reads the test tables at $BENCH_SF_DIR (default /root/testdata/sf0.1), writes
the derived raw meter tables to Parquet once (timed as ``materialize``), then
runs every headline query through a no-op sink (full execution, nothing
collected): one warm-up and $BENCH_RUNS (default 3) timed runs, reporting
the median. Prints one JSON line; ``value`` is the sum of the medians.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from wattle.plans.catalog import QUERIES  # noqa: E402
from wattle.session import build_session, scratch_path  # noqa: E402
from wattle.sources.fixtures import materialize  # noqa: E402

HEADLINE = [
    "clean_consumption", "energy_deltas", "n_phases", "active_profile", "reactive_profile",
    "voltage_profile", "complete_days", "weekend_curve", "season_curves", "domain_audit",
    "audit_consumption", "audit_power", "latest_attribute", "reconcile_entities",
    "meter_locations", "gis_layer_slice", "domain_audit_gis", "orders_latest_priority",
    "orders_reconcile", "events_previous", "reverse_flow_periods", "load_rollup", "coincident_peaks",
    "transformer_loading", "neighbours", "spatial_clusters", "shape_clusters", "voltage_deviation",
    "labelled_measures",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    memory = os.environ.get("BENCH_DRIVER_MEMORY", "16g")
    spark = build_session(
        f"local[{cpus}]", app_name="wattle-bench", shuffle_partitions=4 * cpus,
        extra={"spark.driver.memory": memory},
    )
    spark.sparkContext.setLogLevel("ERROR")
    t0 = time.perf_counter()
    materialize(spark, sf_dir, scratch_path(spark, "bench-raw"),
                ("consumption_raw", "power_raw", "voltages_raw", "customers_raw", "gis_loads",
                 "gis_transformers"))
    timings = {"materialize": round(time.perf_counter() - t0, 3)}
    for key in HEADLINE:
        samples = []
        for i in range(runs + 1):
            t = time.perf_counter()
            QUERIES[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if i:
                samples.append(time.perf_counter() - t)
        timings[key] = round(statistics.median(samples), 3)
    total = round(sum(v for k, v in timings.items() if k != "materialize"), 3)
    print(json.dumps({
        "metric": "sum of median headline query seconds",
        "value": total,
        "unit": "sec",
        "queries": timings,
        "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", ""),
        "cpus": cpus,
        "driver_memory": memory,
        "runs": runs,
        "spark": spark.version,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
