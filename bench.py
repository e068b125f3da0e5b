"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

NAMES = ["x9_difficulty", "x7_kinematic_features", "x11_curriculum", "c1_c6_arm_quality", "a1_pair_summary", "a8_silhouette", "k2_knn", "x12_subset_scores", "g4_candidate_edges", "x15_interference", "x3_dtw_pairs"]


def main() -> None:
    d, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    os.environ.setdefault("OMP_NUM_THREADS", "1")
    os.environ["PYTHONPATH"] = os.pathsep.join([os.path.dirname(os.path.abspath(__file__)), os.environ.get("PYTHONPATH", "")])
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    from kinetra import catalog

    spark.range(10).count()
    took, pairs = {}, 0
    for name in NAMES:
        began = time.time()
        n = catalog.QUERIES[name](spark, d).groupBy().count().first()[0] if name == "x3_dtw_pairs" else catalog.QUERIES[name](spark, d).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
        pairs = n or pairs
        spark.catalog.clearCache()
    print(json.dumps({"metric": "headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(d.rstrip("/")).removeprefix("sf"), "dtw_ms_per_pair": round(1000 * took["x3_dtw_pairs"] / max(pairs, 1), 4)}))
    spark.stop()


if __name__ == "__main__":
    main()
