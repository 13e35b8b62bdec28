"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS], the median of three runs each; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

from tallyloom.plans.catalog import QUERIES
from tallyloom.session import build_session

HEADLINE = [
    "full_analysis", "anova_by", "group_stats", "boxplot", "percentile_lower", "histogram_norm", "kde", "linear_regression", "criteria_match",
    "filter_top_n", "flag_rules", "column_profile", "tally_if", "pivot_totals", "pivot_show_as", "lookup_exact", "lookup_asof", "moving_average",
    "running_total", "ohlc_resample", "doc_sections", "doc_classify", "ref_parse", "secret_scan", "boilerplate_lines", "bool_filter", "merge_papers",
    "rank_papers", "spatial_intersects", "range_consolidate", "fn_date",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session("bench")
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["group_stats"](spark, folder).write.format("noop").mode("overwrite").save()
    took = {}
    for name in HEADLINE:
        runs = []
        for _ in range(3):
            t0 = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - t0)
        took[name] = round(statistics.median(runs), 3)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took,
                      "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
