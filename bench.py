"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1) names the tables and
``BENCH_CPUS`` (default 8) the local cores.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["weekly_panel", "weekly_panel_suppliers", "direct_features", "arx_dataset", "moment_matrix", "ljung_box", "kpss",
            "arma_select", "arma_rolling_one_step", "arma_rolling_suppliers", "gjr_variance_recursion", "var_rolling",
            "model_comparison", "pairwise_dm", "online_scorer", "arx_rolling_refit", "garch_family_fit", "random_forest"]


def main():
    from panelloom.registry import load
    from panelloom.session import local_session, release

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cores=cores)
    queries, _ = load()
    # Start the engine outside the timings.
    spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy("o_orderpriority").count().collect()
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(name, times[name], file=sys.stderr)
        release(spark)
    print(json.dumps({"metric": "headline queries, total wall clock", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
