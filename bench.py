"""Headline queries, timed end to end after one untimed query that starts the JVM's compilers; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from plurifit.session import local_session  # noqa: E402
from plurifit.workload.queries import QUERIES  # noqa: E402

HEADLINE = (
    "fp_all_families", "fp_dictionary", "join_align_xy", "smp_train_test", "smp_repeated_holdout", "smp_stratified_kfold",
    "agg_roc_auc", "join_knn_hamming", "join_knn_euclid", "smp_smote_bits", "cl_split_scan_gini", "flagship",
    "cl_decision_tree",
)
WARM_UP = "join_align_xy"


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    timings = {}
    QUERIES[WARM_UP](spark, sf_dir).write.format("noop").mode("overwrite").save()
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - start, 3)
    result = {
        "metric": "total seconds over the headline queries", "value": round(sum(timings.values()), 3), "unit": "sec",
        "queries": timings, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
