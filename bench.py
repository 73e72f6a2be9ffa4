"""Headline queries, timed end to end; prints one JSON line.

BENCH_SF_DIR  data folder (default /root/testdata/sf0.1)
BENCH_CPUS    local cores (default: all)
BENCH_ONLY    comma-separated query names (default: all headline queries)
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from cohortlab.plans import catalog  # noqa: E402
from cohortlab.plans import experiments as ex  # noqa: E402
from cohortlab.session import local_session  # noqa: E402
from cohortlab.sources.cohorts import ORDERS  # noqa: E402

HEADLINE = (
    "audit_profile",
    "class_distribution",
    "leakage_screen",
    "box_stats",
    "corr_lower",
    "feature_direction",
    "stratified_sample",
    "stratified_split",
    "stratified_folds",
    "standard_scale",
    "smote_resample",
    "leaderboard",
    "roc_curve",
    "average_precision",
    "threshold_tuning",
    "calibration",
    "error_patterns",
    "shuffled_sanity",
    "knn_vote",
    "gaussian_nb",
    "shap_topn",
    "shap_waterfall",
    "risk_tier",
    "counterfactual",
    "risk_percentile",
    "similar_subjects",
    "risk_report",
    "stream_scoring",
    "train_logistic",
    "train_forest",
    "tree_shap",
)
PUBLISHED_SAMPLE = 5000


def full_run(spark, sf):
    """The whole experiment run on a 5,000-row sample: the only published figure to compare with."""
    run = ex.run_experiments(catalog.cohort(spark, sf), ORDERS, sample_n=PUBLISHED_SAMPLE)
    return run.leaderboard()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    only = [q for q in os.environ.get("BENCH_ONLY", "").split(",") if q]
    spark = local_session(cpus, shuffle_partitions=int(cpus))
    named = dict(catalog.all_queries())
    named["full_run_5000"] = full_run
    chosen = only or [*HEADLINE, "full_run_5000"]
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for name in chosen:
        start = time.time()
        named[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    result = {
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": Path(sf_dir).name.removeprefix("sf"),
    }
    print(json.dumps(result), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
