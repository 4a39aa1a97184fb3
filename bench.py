"""Time headline queries and print one JSON line.

BENCH_SF_DIR names the data directory and BENCH_CPUS the number of local cores.
The first entry, ``load``, is the job that writes the processed tables; the
queries after it read those tables.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from boxline.plans.queries import QUERIES
from boxline.sources import star
from boxline.sources.session import local_session

HEADLINE = (
    "normalise_numbers", "filter_transactions", "fixture_match_two_stage", "demographic_enrich", "customer_lifetime", "daily_sales",
    "ticket_price_median", "kpi_summary", "fixture_sales_summary", "audience_summary", "audience_grouping_sets", "segment_fanout",
    "expected_index_segment", "expected_index_ticket_class", "season_comparison", "pace_profile", "required_daily", "forecast_curve",
    "segment_projection", "training_snapshots",
)


def run(df) -> None:
    """Produce every row without bringing any to the driver."""
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = local_session("boxline-bench", cores, int(cores) if cores.isdigit() else 8, "16g")
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()

    timings: dict[str, float] = {}
    start = time.time()
    star.load(spark, sf_dir).write()
    timings["load"] = round(time.time() - start, 3)
    for name in HEADLINE:
        start = time.time()
        run(QUERIES[name](spark, sf_dir))
        timings[name] = round(time.time() - start, 3)
        print(f"{name}: {timings[name]}s", file=sys.stderr, flush=True)
    total = round(sum(timings.values()), 3)
    print(json.dumps({"metric": "total_query_time", "value": total, "unit": "sec", "queries": timings, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
