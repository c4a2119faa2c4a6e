"""Time the headline queries: one JSON line on standard output.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS
(default 8) the cores.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from tablescope.session import configure  # noqa: E402
from workload import catalog, views  # noqa: E402

HEADLINE = [
    "monthly_growth", "kpi_totals_lines", "kpi_median", "kpi_best", "kpi_report", "trend_quarter",
    "top10_product", "share_other_nation", "hist_price", "insights", "role_profile_lineitem",
    "value_checks_lineitem", "distinct_counts", "dedupe_documents", "normalize_text_documents",
    "parse_money", "parse_dates", "jalali_dates", "search_rows", "sort_page",
    "clean_sales", "analyse_untidy_sales", "kpi_report_lines", "chart_selection", "csv_round_trip",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = configure(
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    views.dirty_sales(spark, sf_dir)  # the raw file, not part of the work measured
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.time()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    spark.stop()
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(seconds.values()), 3),
                      "unit": "sec", "queries": seconds, "sf": sf_dir.rstrip("/").split("sf")[-1]}))


if __name__ == "__main__":
    main()
