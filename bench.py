"""Time headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) are read from the environment. Each query
runs once to warm up and once timed, written to a sink that drops its rows.
"""

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

QUERIES = (
    "open_orders spend_band open_share standing_ladder nation_through figure_total across_segments carried_value lead_list lead_median ship_spans tokyo_days"
    " latest_event_value reading_distribution reading_series_delta reading_band_goal reading_live order_page order_page_summary customer_card change_stream citations upsert_and_delete warm_pass events_by_day events_by_week"
).split()


def main() -> None:
    from metricspark import catalogue

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, took = catalogue.queries(), {}
    for name in QUERIES:
        for _ in range(2):
            began = time.perf_counter()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "seconds of all headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": folder.rsplit("sf", 1)[-1].strip("/")}))
    spark.stop()


if __name__ == "__main__":
    main()
