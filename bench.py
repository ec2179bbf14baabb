"""Time the headline queries: one JSON line with seconds per query.

BENCH_SF_DIR names the tables (default /root/testdata/sf0.1), BENCH_CPUS the local
threads. Every query is computed whole: its rows are aggregated to one hash, so no
column can be pruned. ``queries`` holds the second run of each, ``cold`` the first,
``shuffle_mb`` what the second wrote to shuffles. BENCH_QUERIES may name other
registered queries.
"""

from __future__ import annotations

import json
import os
import time

from edgeloom.plans import QUERIES
from edgeloom.session import local_session

HEADLINE = [
    "positive_pairs", "map_cascade", "harmonize", "drug_profile", "exclusive_overlaps", "knn_drugs", "jaccard_targets", "gip", "tfidf_kernel",
    "connected_components", "hop_distance", "meta_path_ddt", "meta_path_dtdt", "negatives_per_drug_1", "negatives_global",
    "negatives_by_distance", "folds_sp", "kfold", "ranking_metrics", "regression_errors", "order_by_median", "linear_index",
]


def run(spark, name, sf):
    from pyspark.sql import functions as F

    start = time.time()
    df = QUERIES[name](spark, sf)
    df.agg(F.count("*"), F.bit_xor(F.xxhash64(*df.columns))).collect()
    return round(time.time() - start, 3)


def shuffle_bytes(spark) -> int:
    """Bytes written to shuffles so far by all executors."""
    found = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))


def main():
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    run(spark, "positive_pairs", sf)  # starts the engine
    cold, times, shuffled = {}, {}, {}
    for n in names:
        cold[n] = run(spark, n, sf)
        before = shuffle_bytes(spark)
        times[n] = run(spark, n, sf)
        shuffled[n] = round((shuffle_bytes(spark) - before) / 1e6, 1)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "cold": cold, "shuffle_mb": shuffled, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
