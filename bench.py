"""Times the headline queries on one machine and prints one JSON line.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1), ``BENCH_CPUS`` (default 8) and ``BENCH_RUNS`` (default 2, the best counts). The inputs
are derived and stored before timing. Steps with a direct form are timed in both forms:
``direct_x`` is the un-rewritten one, ``x`` the one the library runs.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402

from foliospark.plans import accounts, attributes, cohort, grouped, tracking  # noqa: E402
from foliospark.sources.io import run_folder, store  # noqa: E402
from queries import literal  # noqa: E402
from queries.mapping import SPARK_SOURCES, Inputs  # noqa: E402
from queries.steps import COHORT  # noqa: E402

RUNS = int(os.environ.get("BENCH_RUNS", "2"))


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    with run_folder(spark):
        table = Inputs(spark, sf_dir, tuple(SPARK_SOURCES))
        for name in SPARK_SOURCES:
            table(name)
        panel, stock = tracking.build_stock(table)
        master = attributes.master_ids(table("client_master"))
        tracked = store(tracking.build_tracking(table), "tracking")
        queries = {
            "limit_cohort_report": lambda: cohort.limit_cohort(
                table("cohort_month"), table("limit_campaign_stage1"), table("limit_campaign_stage2"), COHORT
            ),
            "direct_limit_cohort_report": lambda: literal.limit_cohort(
                table("cohort_month"), table("limit_campaign_stage1"), table("limit_campaign_stage2"), COHORT
            ),
            "account_panel_and_openings": lambda: tracking.build_stock(table)[1],
            "vintage_outcomes": lambda: attributes.vintage_outcomes(stock, panel),
            "direct_vintage_outcomes": lambda: literal.vintage_outcomes(stock, panel),
            "bureau_windows": lambda: attributes.bureau_windows(table("bureau_month")),
            "direct_bureau_windows": lambda: literal.bureau_windows(table("bureau_month")),
            "vehicle_wealth": lambda: attributes.vehicle_wealth(stock, table("vehicles"), master),
            "direct_vehicle_wealth": lambda: literal.asof_within(stock, attributes.vehicle_totals(table("vehicles"), master), "TasacionTotal", 12),
            "last_application": lambda: attributes.last_application(stock, table("application_log")),
            "direct_last_application": lambda: literal.last_application(stock, table("application_log")),
            "renegotiated": lambda: accounts.renegotiated(table("card_events"), stock),
            "direct_renegotiated": lambda: literal.renegotiated(table("card_events"), stock),
            "tracking": lambda: tracking.build_tracking(table),
            "portfolio_grouped": lambda: grouped.portfolio_grouped(tracked),
            "portfolio_grouped_changes": lambda: grouped.portfolio_grouped_changes(tracked),
        }
        seconds: dict[str, float] = {}
        for name, build in queries.items():
            for _ in range(RUNS):
                start = time.perf_counter()
                run(build())
                took = round(time.perf_counter() - start, 3)
                seconds[name] = min(took, seconds.get(name, took))
        total = round(sum(s for n, s in seconds.items() if not n.startswith("direct_")), 3)
        sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
        print(json.dumps({"metric": "total seconds of the headline queries", "value": total, "unit": "sec", "queries": seconds, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
