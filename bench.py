"""Benchmark: every registered report at one scale factor.

Prints ONE JSON line: {"metric", "value", "unit", "queries", "sf", ...}.
Each report is executed fully with the ``noop`` sink (no driver collect);
its time is the best of ``BENCH_REPEAT`` runs.  Reports over trips read a saved trips
table, as in the production job; deriving and saving it from ``events`` is the line
``derive_trips``, measured in the same way.  The other reports (ingest, tables) start from ``events``.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from cyclestat.plans.config import local_settings  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeat = int(os.environ.get("BENCH_REPEAT", "2"))
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("cyclestat-bench")
    for k, v in local_settings(cpus).items():
        builder = builder.config(k, v)
    spark = builder.config("spark.driver.memory", "8g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")

    from cyclestat import reports
    from cyclestat.sources import fixtures
    from cyclestat.sources.scratch import fresh_path

    spark.range(1000).selectExpr("sum(id)").collect()  # start the JVM side before timing
    times = {}
    errors = {}
    saved = []

    def derive() -> None:
        saved.append(fresh_path(spark, "bench-trips"))
        fixtures.trips(spark, sf_dir).write.parquet(saved[-1])

    def run(name: str) -> None:
        if name in reports.ON_TRIPS:
            df = reports.ON_TRIPS[name](spark.read.parquet(saved[-1]))
        else:
            df = reports.REPORTS[name](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()

    for name in ["derive_trips", *reports.REPORTS]:
        best = None
        try:
            for _ in range(repeat):
                t = time.perf_counter()
                derive() if name == "derive_trips" else run(name)
                el = time.perf_counter() - t
                best = el if best is None else min(best, el)
        except Exception as ex:  # report it, keep measuring the others
            errors[name] = f"{type(ex).__name__}: {str(ex)[:200]}"
            best = None
        times[name] = None if best is None else round(best, 3)

    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {
        "metric": "total_seconds_all_reports",
        "value": round(sum(v for v in times.values() if v is not None), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else sf_dir,
        "cpus": cpus,
        "repeat": repeat,
    }
    if errors:
        out["errors"] = errors
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
