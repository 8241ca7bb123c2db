"""Wall time of the headline reports; prints one JSON line.

All queries run a few times to warm up, then three times each; the median counts. A run
covers building the plan, all its jobs and fetching the rows, and starts from the raw
tables: the fact is joined from line items, orders, parts and suppliers every time.

--duckdb adds the SQL twins. --tables adds the reports on panel tables that were written
once beforehand, as a warehouse would hold them (the time to write them is given too).
"""

from __future__ import annotations

import dataclasses
import json
import os
import statistics
import sys
import time
import uuid

HEADLINE = (
    "report_weekly_metrics",
    "report_weekly_metrics_three_groups",
    "report_market_share",
    "report_growth_contribution",
    "report_head_to_head_gap",
    "report_cancel_add_ratio",
)
WARM_UPS = 3
RUNS = 3


def medians(runs: dict) -> dict[str, float]:
    for _ in range(WARM_UPS):
        for run in runs.values():
            run()
    seconds = {}
    for name, run in runs.items():
        times = []
        for _ in range(RUNS):
            start = time.perf_counter()
            run()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times), 3)
    return seconds


def written_inputs(derived):
    """The same inputs with every panel table written to the shared folder and read back."""
    from panelmetrics.session import shared_folder

    folder = f"{shared_folder(derived.spark)}/bench-{uuid.uuid4().hex}"

    def written(tables, name):
        frames = {}
        for field in dataclasses.fields(tables):
            path = f"{folder}/{name}/{field.name}"
            getattr(tables, field.name).write.parquet(path)
            frames[field.name] = derived.spark.read.parquet(path)
        return type(tables)(**frames)

    return dataclasses.replace(
        derived, sales=written(derived.sales, "sales"), events=written(derived.events, "events")
    )


def main() -> None:
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from checks import ORACLES, QUERIES
    from checks.base import BUILDERS, inputs
    from panelmetrics.session import local_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores)
    spark.sparkContext.setLogLevel("ERROR")

    seconds = medians({name: lambda name=name: QUERIES[name](spark, folder).collect() for name in HEADLINE})
    result = {
        "metric": "headline_reports_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
        "cores": cores,
    }
    if "--tables" in sys.argv:
        start = time.perf_counter()
        tables = written_inputs(inputs(spark, folder))
        result["write_tables"] = round(time.perf_counter() - start, 3)
        result["on_tables"] = medians({name: lambda name=name: BUILDERS[name](tables).collect() for name in HEADLINE})
    if "--duckdb" in sys.argv:
        from checks.compare import duckdb_views

        connection = duckdb_views(folder)
        connection.execute(f"SET threads = {cores}")
        result["duckdb"] = medians(
            {name: lambda name=name: connection.execute(ORACLES[name]).fetchall() for name in HEADLINE}
        )
    spark.stop()
    print(json.dumps(result))


if __name__ == "__main__":
    main()
