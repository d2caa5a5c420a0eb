"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "B1_content_key",
    "B12_engine_defaults",
    "F2_player_gap_sessions",
    "E1_player_profile",
    "G1_top_k_per_bin",
    "D1_selected_games",
    "F12_peak_flags",
    "F_feature_table_from_documents",
    "I3_future_upside",
    "I6_chronological_folds",
    "J5_session_backtest",
    "J6_threshold_sweep",
    "J8_production_search",
    "K8_roc_auc",
    "E8_describe",
    "E9_correlations",
    "H2_first_document_per_text",
    "H4_unique_names",
    "K5_out_of_fold_scores",
]


def main() -> None:
    from gapline.plans import registry
    from gapline.runtime import build_session

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        f"local[{cpus}]",
        "gapline-bench",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": os.environ.get("BENCH_MEMORY", "6g")},
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in names:
        start = time.perf_counter()
        registry.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(sf)}))


if __name__ == "__main__":
    main()
