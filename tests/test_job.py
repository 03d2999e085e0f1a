"""The production job: landed CSV months -> table -> every report."""

import importlib.util
import os

from cyclestat import reports
from cyclestat.sources import csv_trips, fixtures
from cyclestat.sources.scratch import fresh_path

SF = "/root/testdata/sf0.001"
JOB = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "jobs", "trip_reports.py")


def _job():
    spec = importlib.util.spec_from_file_location("trip_reports", JOB)
    m = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(m)
    return m


def test_job_writes_every_report_equal_to_the_library(spark):
    t = fixtures.trips(spark, SF)
    base = fresh_path(spark, "job-feed")
    dirs = []
    for month, header, layout in fixtures.FEED_GENERATIONS:
        d = csv_trips.join_path(base, month)
        fixtures.render_raw_feed(t, header, layout, month).write.option("header", True).csv(d)
        dirs.append(d)
    out = fresh_path(spark, "job-out")
    names = _job().run(spark, dirs, "cyclestat_job_trips", fresh_path(spark, "job-table"), out, rejects=True)
    assert names == [*reports.ON_PATH_FACTS, *reports.ON_TIME_FACTS]
    feed_trips = csv_trips.read_trip_csvs(spark, dirs)
    for name in ("station_uses", "directed_paths_top1000", "hourly_usage", "day_of_week_counts"):
        got = spark.read.parquet(csv_trips.join_path(out, name))
        want = reports.ON_TRIPS[name](feed_trips)
        assert got.count() == want.count()
        assert got.exceptAll(want.select(*got.columns)).count() == 0, name
    rej = spark.read.parquet(csv_trips.join_path(out, "_ingest_rejects")).collect()
    assert sum(r.rows for r in rej) == 3 * t.count() and all(r.bad_starttime == 0 for r in rej)


def test_job_update_rewrites_the_corrected_month_only(spark):
    """A damaged month corrected, and a new one: equal to a run over all files; other months' files stay."""
    t = fixtures.trips(spark, SF)
    base, root = fresh_path(spark, "job-update-feed"), fresh_path(spark, "job-update-table")
    months = {m: csv_trips.join_path(base, m) for m in ("2013-07", "2013-08", "2013-09", "2013-10")}
    lines = fixtures.render_damaged_lines(t, "2013-08")
    for n, m in enumerate(months):
        if m != "2013-08":
            part = t.where(f"trip_id % 4 >= {n}")
            fixtures.render_raw_feed(part, "classic", "iso", m).write.option("header", True).csv(months[m])
    lines.write.option("header", True).option("sep", "\u0001").csv(months["2013-08"])
    job, table = _job(), "cyclestat_job_update"
    job.run(spark, [months[m] for m in ("2013-07", "2013-08", "2013-09")], table, root, fresh_path(spark, "job-update-1"), ["station_uses"])
    assert spark.table(f"{table}_rejects").count() > 0 and spark.table(f"{table}_rejects").select("feed_month").distinct().count() == 1

    def files(month):
        return {f: os.stat(f).st_mtime_ns for n in (table, f"{table}_path_facts", f"{table}_time_facts")
                for f in (p.removeprefix("file:").replace("///", "/") for p in spark.table(n).where(f"feed_month = '{month}'").inputFiles())}

    before = {m: files(m) for m in ("2013-07", "2013-08", "2013-09")}
    fixed = csv_trips.join_path(base, "fixed/2013-08")
    fixtures.render_raw_feed(t.where("trip_id % 3 > 0"), "classic", "iso", "2013-08").write.option("header", True).csv(fixed)
    out = fresh_path(spark, "job-update-2")
    names = job.run(spark, [fixed, months["2013-10"]], table, root, out, rejects=True, update=True)
    assert all(files(m) == before[m] for m in ("2013-07", "2013-09")) and not set(files("2013-08")) & set(before["2013-08"])
    assert spark.table(f"{table}_rejects").count() == 0  # the corrected month's rejects went with it
    whole = csv_trips.read_trip_csvs(spark, [months["2013-07"], fixed, months["2013-09"], months["2013-10"]])
    got = spark.table(table).drop("source_file", "feed_month")
    assert got.count() == whole.count() and got.exceptAll(whole.select(*got.columns)).count() == 0
    for name in names:  # every report from merged parts equals the direct one
        merged, want = spark.read.parquet(csv_trips.join_path(out, name)), reports.ON_TRIPS[name](whole)
        assert merged.count() == want.count() and merged.exceptAll(want.select(*merged.columns)).count() == 0, name
    one = spark.table(table).where("feed_month = '2013-10'")
    assert all("feed_month=2013-10" in f for f in one.inputFiles())


def test_job_command_line(spark):
    t = fixtures.trips(spark, SF)
    d = csv_trips.join_path(fresh_path(spark, "job-cli-feed"), "2013-07")
    fixtures.render_raw_feed(t, "classic", "iso", "2013-07").write.option("header", True).csv(d)
    out = fresh_path(spark, "job-cli-out")
    _job().main(["--paths", d, "--table", "cyclestat_job_cli", "--table-path", fresh_path(spark, "job-cli-table"),
                 "--out", out, "--reports", "station_uses", "day_of_week_counts", "weekday_trips"])
    assert not os.path.exists(os.path.join(out, "weekend_trips"))
    assert spark.read.parquet(csv_trips.join_path(out, "weekday_trips")).count() > 0
    got = spark.read.parquet(csv_trips.join_path(out, "day_of_week_counts"))
    assert got.agg({"count": "sum"}).first()[0] == t.count()
