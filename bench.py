"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the local cores. Each query
runs to its full result: once cold, then BENCH_RUNS more times (best kept).
"""
from __future__ import annotations

import json
import os
import time

from rotapanel.catalog import load_all
from rotapanel.catalog.common import base
from rotapanel.session import build_session

HEADLINE = [
    "d7_unemployment_rate_quarterly",
    "d7_unemployment_rate_annual",
    "h8_size_normalised_quarter",
    "e4_moving_quarter",
    "k3_overlap_of_units",
    "k30_trajectories",
    "d17_weight_summary",
    "i4_calibrate_each_quarter",
    "i5_integrative_calibration",
    "j3_two_way_totals",
    "j6_annual_variance_blocks",
    "j11_covariance_of_means",
    "j18_design_t_test",
    "k18_area_under_curve",
    "k29_weight_chain",
    "l2_transition_totals",
    "l13_models_a_to_d",
    "l19_parameters_with_error",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = build_session(cores, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    registered = load_all()

    def timed(run) -> float:
        start = time.perf_counter()
        run().write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    start = time.perf_counter()
    rows = base(spark, sf_dir).count()
    cold, best = {"ingest_base": round(time.perf_counter() - start, 3)}, {}
    for name in HEADLINE:
        query = registered[name].run
        cold[name] = round(timed(lambda: query(spark, sf_dir)), 3)
        best[name] = round(min(timed(lambda: query(spark, sf_dir)) for _ in range(runs)), 3)
    best["ingest_base"] = cold["ingest_base"]
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(best.values()), 3),
                "unit": "sec",
                "queries": best,
                "cold": cold,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cores": int(cores),
                "shuffle_partitions": int(spark.conf.get("spark.sql.shuffle.partitions")),
                "person_quarters": rows,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
