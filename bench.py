"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from tidemark.registry import QUERIES
from tidemark.runtime import local_session

HEADLINE = [
    "a2_text_csv_scan",
    "a5_parquet_scan",
    "c1_daily_rollup",
    "c2_hourly_rollup",
    "c12_medians",
    "c13_grouped_quantiles",
    "d1_lookup_join",
    "d2_full_outer_join",
    "e7_keep_first",
    "f2_lag_features",
    "f5_seasonal_decomposition",
    "h1_monthly_recovery",
    "h4_station_features",
    "h5_shock_recovery",
    "h6_divergence_without_modes",
    "h8_commute_verdict",
    "h12_overall_verdict",
    "h14_skills_preparation",
    "h16_tech_density",
    "h17_skill_pairs",
    "h18_postings_preparation",
    "h20_seed_scores",
    "h24_group_comparison",
    "h25_feature_matrix",
    "i1_unit_root_tests",
    "i3_break_batch",
    "i4_sensitivity_scan",
    "i11_correlations_by_era",
    "i14_density_curves",
    "i15_box_summary",
    "u1_spearman",
    "u2_mann_whitney",
    "j1_term_weights",
    "j4_topic_factorisation",
    "j6_station_clusters",
    "j12_ridge",
    "j18_arima_forecast",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cores, int(cores) if cores.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["c1_daily_rollup"](spark, sf_dir).count()  # start the JVM's code paths once
    seconds: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
