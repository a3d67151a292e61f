"""Headline timings: one JSON line. BENCH_SF_DIR and BENCH_CPUS choose the data and cores."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = (
    "P1_subset", "P13_trilinear_sample", "S14_field_stats", "C2_nearest_column", "C9_collocate", "A3_coverage_profiles", "C19_settings_sweep",
    "R2_connected_regions", "R13_evolution", "W16_field_gradient", "W13_mixed_layer", "A8_seasonal_pool_climatology", "W8_event_metrics",
    "F5_compare_events", "E3_exclude_and_recompute", "E10_fingerprint", "W17_step_distance", "S6_read_observation_csv",
)


def main() -> None:
    from pyspark.sql import SparkSession

    from brinefield import registry

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").config("spark.sql.shuffle.partitions", cpus)
             .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g")).config("spark.sql.session.timeZone", "UTC")
             .config("spark.python.sql.dataFrameDebugging.enabled", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry.queries()
    queries["S14_field_stats"](spark, sf_dir).collect()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    samples = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    cells = queries["S14_field_stats"](spark, sf_dir).agg({"valid": "sum"}).first()[0]
    rates = {"collocated_samples_per_sec": round(samples / times["C9_collocate"]), "csv_samples_per_sec": round(samples / times["S6_read_observation_csv"]),
             "region_cells_per_sec": round(cells / times["R2_connected_regions"])}
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "rates": rates,
                      "sf": sf_dir.rsplit("sf", 1)[-1], "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
