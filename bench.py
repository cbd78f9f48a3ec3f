"""Wall seconds of the headline queries: one JSON line on stdout.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
Every query is run to the end into the no-op sink, up to three times (once if it is slow); the median counts.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

from gapline.session import local_session
from gapline.suite import all_queries

HEADLINE = (
    "gap_episodes", "short_gap_clusters", "episode_bounds", "delivery_episodes", "nearest_anchor",
    "interval_containment", "nearest_other_row", "pivot_last", "outer_merge", "collapse_near_dups", "unpivot_times",
    "window_stats", "locf_grid", "snapshot_features", "personalized_deltas", "label_pre_dose", "label_post_dose",
    "lookback_features", "postpartum_features", "sequence_export", "episode_labels", "label_intersection",
    "mothers_static", "child_codes", "matrix_build", "impute_standardize", "histogram_by_label", "balanced_sample",
    "group_kfold", "ranking_metrics", "resample_balanced", "plausibility_mask", "fold_plumbing", "fold_imputation",
    "permutation_importance",
)


REPEATS = 3
#: No further run of a query after this time.
ENOUGH_SECONDS = 8


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"))
    registered = all_queries()
    # start the engine before the first timing
    spark.read.parquet(f"{sf_dir}/nation.parquet").groupBy("n_regionkey").count().write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        runs = []
        while len(runs) < REPEATS and sum(runs) < ENOUGH_SECONDS:
            start = time.time()
            registered[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - start)
        seconds[name] = round(statistics.median(runs), 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "total_wall_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": float(scale.group(1)) if scale else None,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
