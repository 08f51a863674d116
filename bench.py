"""Headline queries, timed once each after a warm-up; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
Results go to a no-op sink, so every row is computed and none is collected.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tabcal.catalog import load_registry
from tabcal.session import local_session

HEADLINE = [
    "recode_summary_a6", "semantic_recode_s16", "domain_groups_s15", "conditional_impute_s18",
    "missingness_policy_p7", "numeric_profile_a10", "iqr_outlier_summary_p12", "cardinality_report_a8", "group_composition_a17",
    "correlation_matrix_a13", "duplicate_flags_w6", "group_median_w3", "group_split_sp4", "balanced_manifest_sp6", "group_folds_sp7",
    "leakage_audit_a19", "target_encoding_e9", "standardise_e5", "rare_categories_e8", "metrics_row_a2", "errors_by_supplier_a3",
    "held_out_shift_a24", "conformal_quantile_c1", "interval_table_c7", "interval_metrics_c8", "confidence_labels_c10",
    "vif_m12", "leave_group_out_m16", "grid_search_m9", "nearest_neighbours_knn1", "interval_methods_c15",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, "bench")
    registry = load_registry()
    registry["recode_summary_a6"][0](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
    timings: dict[str, float] = {}
    for name in chosen:
        started = time.perf_counter()
        registry[name][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - started, 3)
        print(f"{name} {timings[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total wall time of headline queries", "value": round(sum(timings.values()), 3), "unit": "sec",
        "queries": timings, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
