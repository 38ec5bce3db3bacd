"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from foldlens.plans.catalog import QUERIES
from foldlens.session import local_session

HEADLINE = (
    "confusion_matrix", "overall_metrics", "class_report", "log_loss_brier", "reliability_bins", "ovr_auc", "subgroup_accuracy_wilson", "wga_sensitivity",
    "rate_table", "eod_summary", "eod_legacy_skip", "paired_fold_delta", "sign_flip_test", "rater_agreement_kappa", "stratified_folds", "validation_split",
    "nearest_centroid_oof", "standardize_train_only", "value_mapping", "crosstab_axes", "exact_duplicates", "hamming_pairs", "cross_role_leakage",
    "entity_leakage", "connected_components", "nested_counts_merge", "table_fingerprint",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for name in HEADLINE:
        began = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf_dir.rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
