"""Time the headline flows; prints one JSON line.

BENCH_SF_DIR names the table folder, BENCH_CPUS the local cores.  A query is
built, planned and run from scratch each time; the best of BENCH_RUNS counts.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from checks.queries import QUERIES
from deskgauge.session import tuned

HEADLINE = {
    "q1": "q1_employee_movement_calendar",
    "q2": "q2_rdv_calendar",
    "q4": "q4_under_observation_count",
    "q9": "q9_suspended_mail_table",
    "q11": "q11_suspended_mail_count",
    "q13": "q13_suspended_too_long_count",
    "q15": "q15_contacted_count",
    "q24": "q24_ticket_flow_rows_all",
    "q26": "q26_ticket_flow_score_all",
    "q27": "q27_tickets_by_expiration",
    "q28": "q28_technician_table",
    "q30": "q30_points_bins",
    "s1": "s1_ticket_extract",
    "s2": "s2_action_extract",
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = (
        tuned(SparkSession.builder.master(f"local[{cpus}]").appName("bench"))
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    building: dict[str, float] = {}
    for name, key in HEADLINE.items():
        for _ in range(runs):
            started = time.perf_counter()
            frame = QUERIES[key](spark, sf_dir)
            built = time.perf_counter() - started
            # Every output column is produced, without moving rows to Python.
            frame.write.format("noop").mode("overwrite").save()
            elapsed = time.perf_counter() - started
            times[name] = round(min(elapsed, times.get(name, elapsed)), 3)
            building[name] = round(min(built, building.get(name, built)), 3)
        print(f"{key} {times[name]} (building {building[name]})", file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "building": building, "sf": os.path.basename(sf_dir).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
