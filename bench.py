"""Runs the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line of their seconds.

Each query runs once to warm up and three times to be timed; the least counts.
"""

import json
import os
import re
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "i1_ols", "i1_simple_regression", "i3_weighted", "d13_gram", "d1_profile", "d2_correlation_pearson", "g2_t_welch", "g6_mann_whitney", "h1_one_way", "k5_influence", "k18_cluster", "l1_fixed_effects", "l5_arellano_bond",
    "m1_two_stage", "m10_psm", "m13_ipw", "m14_aipw", "c3_nearest_join", "n1_autoregression", "o1_kaplan_meier", "o2_log_rank", "j5_logistic", "r2_pagerank", "t1_hmc", "e5_average_ranks", "b10_impute_mean", "c1_merge", "q8_registration", "s3_sar", "c6_knn_blocks",
]


def main() -> None:
    from pyspark.sql import SparkSession

    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    from estima import catalog

    queries, seconds = catalog.queries(), {}
    for name in HEADLINE:
        times = []
        for _ in range(4):
            began = time.perf_counter()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        seconds[name] = round(min(times[1:]), 3)
    sf = re.search(r"sf([\d.]+)", folder)
    print(json.dumps({"metric": "seconds of all headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": float(sf[1]) if sf else None}))


if __name__ == "__main__":
    main()
