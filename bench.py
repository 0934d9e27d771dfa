"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma-separated names; "all" for every registered query).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from riskweft.plans import REGISTRY  # noqa: E402
from riskweft.session import build_session  # noqa: E402

HEADLINE = [
    "loss_ratio_overall",
    "loss_ratio_by_province",
    "loss_ratio_by_province_vehicle_gender",
    "kpis_by_province",
    "top_postal_code_kpis",
    "monthly_trend",
    "risk_matrix_province_vehicle",
    "executive_summary",
    "filter_conjunction",
    "impute_numeric_median",
    "forward_fill_over_time",
    "outliers_cap_iqr",
    "outlier_report",
    "dedupe_keep_first",
    "duplicate_rows_by_key",
    "derived_features",
    "missing_by_column",
    "categorical_summary",
    "quality_score",
    "describe_numeric",
    "premium_statistics_by_province",
    "correlation_matrix",
    "spearman_matrix",
    "hypothesis_battery",
    "histogram_premium",
    "density_premium",
    "boxplot_premium_by_province",
    "resample_month_sum",
    "prepared_features",
    "linear_regression_training",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(REGISTRY) if chosen == "all" else [n for n in chosen.split(",") if n] or HEADLINE
    spark = build_session(
        "bench",
        master=f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false",
        spark__driver__memory="12g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    # One run of the smallest query starts the executor threads and loads classes.
    REGISTRY["loss_ratio_by_province"].run(spark, folder).collect()
    timings = {}
    for name in names:
        start = time.perf_counter()
        REGISTRY[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - start, 3)
        spark.catalog.clearCache()
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
