"""Scale runs: the reports over ``events`` replicated N times under fresh ids.

    python scale_bench.py --replicate 10 100 [--hot-share 0.33] [--reports a b]

The replicated tables are derived by Spark from the given ones (each event
becomes N events with ids ``id * N + r``) and written to the shared scratch
folder.  ``--hot-share`` gives that share of all events to a single user,
the skew case the trips derivation must survive.  Prints one JSON line per
replication factor; this is a measurement tool, not a registered query.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from cyclestat.plans.config import local_settings  # noqa: E402


def shuffle_bytes_by_group(log_dir: str, app_id: str) -> dict[str, int]:
    """Shuffle bytes written per job group, from Spark's event log."""
    import glob
    import io
    import json as _json

    files = [f for f in glob.glob(os.path.join(log_dir, "**", f"*{app_id}*"), recursive=True)
             if os.path.isfile(f) and not os.path.basename(f).startswith("appstatus")]
    stage_group: dict[int, str] = {}
    out: dict[str, int] = {}
    for f in files:
        raw = open(f, "rb").read()
        if f.endswith(".zstd"):
            import zstandard
            raw = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw)).read()
        for line in raw.decode().splitlines():
            e = _json.loads(line)
            if e["Event"] == "SparkListenerJobStart":
                grp = (e.get("Properties") or {}).get("spark.jobGroup.id")
                for st in e["Stage IDs"]:
                    stage_group[st] = grp
            elif e["Event"] == "SparkListenerTaskEnd":
                grp = stage_group.get(e["Stage ID"])
                m = (e.get("Task Metrics") or {}).get("Shuffle Write Metrics") or {}
                if grp:
                    out[grp] = out.get(grp, 0) + m.get("Shuffle Bytes Written", 0)
    return out


def planned_scans(df) -> int:
    """File or checkpoint scans in the physical plan (exchanges reused at run
    time are counted once more here, so this is an upper bound)."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("FileScan ") + plan.count("Scan ExistingRDD")


def replicate(spark, sf_dir: str, n: int, hot_share: float) -> str:
    from cyclestat.sources.csv_trips import join_path
    from cyclestat.sources.scratch import fresh_path

    out = fresh_path(spark, f"replica-x{n}")
    ev = spark.read.parquet(join_path(sf_dir, "events.parquet"))
    rep = ev.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("_r"))
    user = F.col("user_id") * n + F.col("_r")
    if hot_share > 0:
        # a deterministic share of all events goes to user -1
        bucket = F.abs(F.xxhash64("event_id", "_r")) % 1000
        user = F.when(bucket < int(hot_share * 1000), F.lit(-1).cast("bigint")).otherwise(user)
    rep = rep.withColumns({"event_id": F.col("event_id") * n + F.col("_r"), "user_id": user,
                           "ts": F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("_r") % 7)})
    rep.drop("_r").write.mode("overwrite").parquet(join_path(out, "events.parquet"))
    spark.read.parquet(join_path(sf_dir, "nation.parquet")).write.mode("overwrite") \
        .parquet(join_path(out, "nation.parquet"))
    return out


def main() -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf-dir", default=os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"))
    ap.add_argument("--replicate", type=int, nargs="+", default=[10])
    ap.add_argument("--hot-share", type=float, default=0.0)
    ap.add_argument("--reports", nargs="*", default=None)
    ap.add_argument("--cpus", type=int, default=int(os.environ.get("BENCH_CPUS", "8")))
    ap.add_argument("--event-log", default=None, help="folder for Spark's event log (stage/task times)")
    a = ap.parse_args()

    b = SparkSession.builder.master(f"local[{a.cpus}]").appName("cyclestat-scale")
    for k, v in local_settings(a.cpus).items():
        b = b.config(k, v)
    if a.event_log:
        b = b.config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", a.event_log)
    spark = b.config("spark.driver.memory", "16g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")

    from cyclestat import reports
    from cyclestat.sources import fixtures

    results = []
    for n in a.replicate:
        t = time.perf_counter()
        d = replicate(spark, a.sf_dir, n, a.hot_share)
        prep = time.perf_counter() - t
        t = time.perf_counter()
        trips = fixtures.trips(spark, d)
        times = {"trips_build": round(time.perf_counter() - t, 3)}
        scans = {}
        rows = trips.count()
        for name, fn in reports.REPORTS.items():
            if a.reports and name not in a.reports:
                continue
            spark.sparkContext.setJobGroup(f"x{n}:{name}", name)
            t = time.perf_counter()
            df = fn(spark, d)
            df.write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - t, 3)
            scans[name] = planned_scans(df)
        results.append({"replicate": n, "hot_share": a.hot_share, "trips": rows,
                        "prepare_sec": round(prep, 3), "total_sec": round(sum(times.values()), 3),
                        "queries": times, "scans": scans})
    app_id = spark.sparkContext.applicationId
    spark.stop()
    if a.event_log:
        by_group = shuffle_bytes_by_group(a.event_log, app_id)
        for r in results:
            r["shuffle_mb"] = {q: round(by_group.get(f"x{r['replicate']}:{q}", 0) / 2**20, 2)
                               for q in r["queries"] if q != "trips_build"}
    for r in results:
        print(json.dumps(r), flush=True)


if __name__ == "__main__":
    main()
