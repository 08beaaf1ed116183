"""Headline queries, timed: one JSON line. BENCH_SF_DIR, BENCH_CPUS and BENCH_QUERIES set the run."""

from __future__ import annotations

import json
import os
import sys
import time

from pairlab.plans import load_queries
from pairlab.session import build_session

HEADLINE = (
    "scan_parquet", "json_flatten", "html_rows", "stat_variants", "wide_assemble", "orient_pairs",
    "pair_dim_join", "stat_diff", "composite_index", "resolve_cascade", "resolve_pairs", "feature_quantiles",
    "mcc_scores", "mi_binned", "mi_knn", "pearson_matrix", "dedup_correlated", "segment_accuracy", "logloss_by_group",
    "model_corr", "prior_blend", "conformal_thresholds", "conformal_coverage", "hit_report", "upset_budget",
    "knockout_full", "fit_late",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = os.environ.get("BENCH_QUERIES")
    names = wanted.split(",") if wanted else HEADLINE
    spark = build_session(cpus, "bench", **{"spark.sql.shuffle.partitions": cpus if cpus.isdigit() else "8"})
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = load_queries()
    queries["scan_parquet"](spark, sf_dir).collect()  # warm the JVM, untimed
    seconds: dict[str, float] = {}
    for name in names:
        start = time.time()
        try:
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.time() - start, 3)
        except Exception as error:
            print(f"{name}: {error}", file=sys.stderr)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
