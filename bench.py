"""Time the headline queries and print one JSON line.

Folder and cores come from BENCH_SF_DIR and BENCH_CPUS. Each query runs once untimed, then twice timed
into the noop sink; the better time counts. Tables are read from parquet every time, nothing is cached.
Query names on the command line replace the headline list; `all` times every query. `relative` gives each query as a
multiple of a yardstick (one scan and one shuffle of lineitem, timed before and after the queries), so that rounds on
machines of different speed compare. `more` are queries beside the headline, which the total does not count.
"""

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from kickstand.plans.catalog import all_queries  # noqa: E402
from kickstand.session import build_session  # noqa: E402

HEADLINE = [
    "daily_trips_by_vendor",
    "avg_trips_by_vendor",
    "hourly_demand_by_vendor",
    "service_events_per_day",
    "avg_downtime_per_vehicle",
    "weekly_fleet_maintenance_percent",
    "incidents_by_type",
    "incidents_per_1k_trips",
    "workload_trips_hour",
    "trips_heatmap",
    "incidents_per_10k_km",
    "measures_cube",
    "trip_cost_by_vendor_month",
    "daily_median",
    "trip_cost",
    "task_linkage",
    "vendor_monthly",
    "incident_summary",
    "expected_demand",
    "demand_vs_expected",
]
MORE = ["canon_hourly", "demand_shares", "load_vs_handle", "expected_incidents", "task_candidates", "incidents_cube", "vehicles_out_by_hour"]
TIMED_RUNS = 2


def yardstick(spark, sf_dir):
    """A fixed piece of work that no change to the library touches."""
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_partkey").count()


def run(query, spark, sf_dir):
    start = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        f"local[{cpus}]",
        app="kickstand-bench",
        shuffle_partitions=cpus if cpus.isdigit() else 8,
        spark__driver__memory="8g",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    names = sys.argv[1:] or HEADLINE
    names = list(queries) if names == ["all"] else names

    def best(query):
        run(query, spark, sf_dir)
        return round(min(run(query, spark, sf_dir) for _ in range(TIMED_RUNS)), 3)

    before = best(yardstick)
    seconds = {name: best(queries[name]) for name in names}
    more = {name: best(queries[name]) for name in ([] if sys.argv[1:] else MORE)}
    unit = min(before, best(yardstick))
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline queries, total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "more": more,
                "yardstick": unit,
                "relative": {name: round(t / unit, 2) for name, t in (seconds | more).items()},
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
