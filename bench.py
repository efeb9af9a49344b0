"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from cohortica.plans import load_queries
from cohortica.session import build_session

HEADLINE = [
    "a1_period_profile", "a17_monthly_gini", "a18_average_precision", "a19_monthly_blend_gini",
    "a25_score_distribution", "a27_score_correlation", "a16_cramers_v", "b3_delta_vs_baseline",
    "e2_grouped_blend", "e5_quantile_map", "e7_grid_weights", "p9_behavioural_ratios",
    "p10_calendar_features", "p18_quantile_bins", "s9_stratified_sample", "v6_absorbing_event",
    "w1_history_features", "w6_trajectory", "w9_rank_all_columns", "w10_cohort_ranks",
    "w14_causal_target_encoding", "m2_logistic", "m7_cox_gini", "b2_bootstrap_ginis", "m6_cloglog_gini", "s12_permute_column",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", cpus, int(cpus) if cpus.isdigit() else 8)
    queries = load_queries()[0]
    names = sys.argv[1:] or HEADLINE
    queries["a1_period_profile"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # JVM warm-up
    times = {}
    for name in names:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf}))
    spark.stop()


if __name__ == "__main__":
    main()
