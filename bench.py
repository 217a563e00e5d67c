"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from adplan.checks import inputs as inp
from adplan.checks.queries import QUERIES
from adplan.sources.stage import settle

HEADLINES = [
    "ads_kpis", "campaign_breakdown", "product_breakdown", "search_term_breakdown", "all_breakdowns",
    "trend_weekly", "trend_monthly", "resolve_date", "parse_date_range", "parse_ads", "merge_asin_view",
    "asin_health", "forecast_by_product", "entity_months", "optimise_budget", "recommend_campaigns",
    "anomalies", "actions",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("adplan-bench")
             .config("spark.sql.shuffle.partitions", cpus)
             .config("spark.sql.files.maxPartitionBytes", "4m")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.driver.memory", "8g")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["campaign_breakdown"](spark, folder).count()  # start-up

    def timed(run) -> float:
        start = time.perf_counter()
        run().write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    times = {name: timed(lambda n=name: QUERIES[n](spark, folder)) for name in HEADLINES}

    # The bulk breakdown over a staged report, against one aggregation per dimension.
    from adplan.operators import breakdowns as bd
    staged = settle(inp.ads(spark, folder), "bench")
    times["staged_all_breakdowns"] = timed(lambda: bd.all_breakdowns(staged))
    times["staged_five_breakdowns"] = round(sum(
        timed(lambda c=c: bd.breakdown(staged, c, bd.FULL_MEASURES))
        for c in ("campaign_name", "asin", "match_type", "bid_strategy", "campaign_type")), 3)
    times["staged_group_by"] = timed(lambda: bd.breakdown(staged, "campaign_name"))
    spark.stop()
    print(json.dumps({"metric": "headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": folder.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
