"""Seconds per headline query on $BENCH_SF_DIR with local[$BENCH_CPUS]; one JSON line.

Each query is run in full into a sink that discards the rows. A first small run of a JVM
query and a Python query warms the session up and is not counted.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from catalog.queries import REGISTRY  # noqa: E402
from traitscope.session import get_spark  # noqa: E402

HEADLINE = [
    "predicate_counts",
    "denote_distinct",
    "dedup_texts",
    "token_matches",
    "pattern_counts",
    "cluster_fitness",
    "ablation_loss",
    "candidate_losses",
    "duplicate_predicates",
    "predicate_correlation",
    "token_propose",
    "predicate_report",
    "extremes_sample",
    "screen_sample",
    "pairwise_f1",
    "matched_metrics",
    "auc_roc",
    "best_threshold_f1",
    "hashed_bow_embed",
    "verdict_cache",
    "centroids",
    "project_scores",
    "assign_argmax",
    "kmeanspp_seed",
    "ema_curve",
    "permutation_band",
    "time_percentile",
    "refine_centers",
    "cluster_directions",
    "class_fitness",
    "series_fitness",
    "fit_clusters",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    spark = get_spark("bench", cores=cpus, shuffle_partitions=int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    for name in ("predicate_counts", "project_scores"):
        REGISTRY[name](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in chosen:
        began = time.time()
        REGISTRY[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - began, 3)
        print(name, seconds[name], file=sys.stderr)
    out = {
        "metric": "total seconds of the headline queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(out))


if __name__ == "__main__":
    main()
