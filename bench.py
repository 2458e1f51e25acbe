"""Times the headline queries and prints one JSON line.

Every query is timed from its call to the last row written; tables that several queries
share are landed first and reported as a query of their own.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

HEADLINE = [
    "nine_signal_scores", "score_panel", "liquidity_stats", "formation_universe", "value_subset_whole_market",
    "book_daily_returns", "study_summary", "placement", "minimum_variance_weights", "paired_optimisation_gain",
    "returns_panel", "grid_summary", "grid_random_metrics", "grid_placement", "universe_minimum_variance",
    "statement_scores", "book_to_market", "turnover_screen", "final_panel", "local_factors", "factor_regression",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "4")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.sql.shuffle.partitions", str(2 * int(cpus)))
             .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "5g")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.log.level", "ERROR").getOrCreate())
    from pitscreen.catalog import load
    from pitscreen.catalog.registry import tables

    queries, _ = load()
    spark.range(1000).selectExpr("sum(id)").collect()
    times: dict[str, float] = {}
    t0 = time.perf_counter()
    tables(spark, sf_dir)
    times["land_market_tables"] = round(time.perf_counter() - t0, 3)
    for name in HEADLINE:
        t0 = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
