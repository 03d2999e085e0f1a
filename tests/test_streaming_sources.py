import os
import threading

import pytest

from cyclestat.sources import csv_trips, fixtures, scratch
from cyclestat.sources.scratch import fresh_path
from cyclestat.sources.tables import drop_table, expire, read_table, replace_parts, save_table, versions
from cyclestat.operators import stations, usage
from cyclestat.streaming import latest_version, publish_running, running_report, stream_trip_csvs, write_trips_stream

SF = "/root/testdata/sf0.001"


def test_feed_file_names_follow_both_styles():
    names = csv_trips.feed_file_names()
    assert len(names) == 49
    assert names[0] == "2013-07 - Citi Bike trip data.csv"
    assert names[13] == "2014-08 - Citi Bike trip data.csv"
    assert names[14] == "201409-citibike-tripdata.csv"
    assert names[-1] == "201707-citibike-tripdata.csv"
    assert csv_trips.feed_paths("s3a://bucket/x/", "2016-12", "2017-01") == [
        "s3a://bucket/x/201612-citibike-tripdata.csv", "s3a://bucket/x/201701-citibike-tripdata.csv"]


def _land_feed(spark):
    t = fixtures.trips(spark, SF)
    base = fresh_path(spark, "landing")
    for month, header, layout in fixtures.FEED_GENERATIONS:
        fixtures.render_raw_feed(t, header, layout, month).coalesce(1) \
            .write.option("header", True).csv(csv_trips.join_path(base, month))
    return t, base


def test_stream_ingest_equals_batch_ingest(spark):
    t, base = _land_feed(spark)
    dirs = [csv_trips.join_path(base, m) for m, _, _ in fixtures.FEED_GENERATIONS]
    schema = csv_trips.master_schema(spark, dirs[0])
    batch = csv_trips.read_trip_csvs(spark, dirs)
    # a stream over the landing folder's month directories
    stream = stream_trip_csvs(spark, csv_trips.join_path(base, "*"), schema, max_files_per_trigger=1,
                              source_column=None)
    out = fresh_path(spark, "stream-out")
    q = write_trips_stream(stream, out, fresh_path(spark, "stream-ckpt"))
    q.awaitTermination(120)
    got = spark.read.parquet(out)
    assert got.count() == batch.count() == 3 * t.count()
    assert got.exceptAll(batch.select(*got.columns)).count() == 0


def _version_files(path):
    return [os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")]


def test_a_reader_always_finds_the_table(spark):
    name, path = "cyclestat_test_always", fresh_path(spark, "always")
    save_table(spark.range(10), name, path=path)
    seen, failed, stop = set(), [], threading.Event()

    def read():
        own = spark.newSession()
        while not stop.is_set():
            try:
                seen.add(own.table(name).count())
            except Exception as ex:  # noqa: BLE001
                failed.append(str(ex)[:300])

    reader = threading.Thread(target=read)
    reader.start()
    for i in range(1, 8):
        save_table(spark.range(10 * (i + 1)), name, path=path, keep=3)
    stop.set()
    reader.join()
    assert not failed and seen <= {10 * i for i in range(1, 9)} and len(seen) > 1
    drop_table(spark, name)
    assert not _version_files(path)


def test_ten_replaces_leave_bounded_files(spark):
    name, path = "cyclestat_test_bounded", fresh_path(spark, "bounded")
    for i in range(10):
        save_table(spark.range(100).coalesce(1), name, path=path)
    assert len(versions(spark, name)) == 2 and len(_version_files(path)) == 2
    assert read_table(spark, name).count() == 100
    save_table(spark.range(5).coalesce(1), name, path=path, older_than=3600)  # superseded just now: all stay
    assert len(versions(spark, name)) == 3 and expire(spark, name, keep=1) and len(_version_files(path)) == 1
    assert read_table(spark, name).count() == 5
    drop_table(spark, name)


def test_a_failing_switch_keeps_the_old_table(spark, monkeypatch):
    name, path = "cyclestat_test_switch", fresh_path(spark, "switch")
    save_table(spark.range(7).coalesce(1), name, path=path)
    run = type(spark).sql

    def broken(self, text, *a, **k):
        if text.startswith("CREATE OR REPLACE VIEW"):
            raise RuntimeError("no catalog")
        return run(self, text, *a, **k)

    monkeypatch.setattr(type(spark), "sql", broken)
    with pytest.raises(RuntimeError, match="no catalog"):
        save_table(spark.range(3).coalesce(1), name, path=path)
    monkeypatch.undo()
    assert read_table(spark, name).count() == 7 and len(versions(spark, name)) == 1 and len(_version_files(path)) == 1
    drop_table(spark, name)


def test_one_month_is_replaced_and_the_others_keep_their_files(spark):
    name, path = "cyclestat_test_month", fresh_path(spark, "month")
    months = ["2013-07", "2013-08", "it's %=/x", None]
    rows = [(i, months[i % 4]) for i in range(40)]
    save_table(spark.createDataFrame(rows, "id long, month string"), name, path=path, partition_by=["month"])
    before = {f: os.stat(f).st_mtime_ns for f in _version_files(path)}
    again = spark.createDataFrame([("2013-08", 1000 + i) for i in range(5)], "month string, id long")
    replace_parts(again, name, path=path)
    got = sorted(map(tuple, read_table(spark, name).select("id", "month").collect()))
    assert got == sorted([r for r in rows if r[1] != "2013-08"] + [(1000 + i, "2013-08") for i in range(5)])
    after = {f: os.stat(f).st_mtime_ns for f in _version_files(path)}
    assert all(after[f] == before[f] for f in before)  # the old version is kept as well
    touched = {f for f in after if f not in before}
    assert touched and all("month=2013-08" in f for f in touched)
    gone = expire(spark, name, keep=1)
    left = set(_version_files(path))
    assert len(gone) == 1 and not any("month=2013-08" in f for f in left & set(before))
    assert left == {f for f in before if "month=2013-08" not in f} | touched
    assert sorted(map(tuple, read_table(spark, name).select("id", "month").collect())) == got
    replace_parts(spark.createDataFrame([("2014-01", 7)], "month string, id long"), name, path=path)  # a new month
    assert read_table(spark, name).count() == len(got) + 1
    plan = read_table(spark, name).where("month = '2014-01'")
    assert len(plan.inputFiles()) == 1 and plan.count() == 1
    with pytest.raises(ValueError, match="columns"):
        replace_parts(spark.range(1), name, path=path)
    drop_table(spark, name)
    assert not _version_files(path)


def test_a_stream_stops_at_a_file_with_other_columns(spark):
    t, base = _land_feed(spark)
    schema = csv_trips.master_schema(spark, csv_trips.join_path(base, fixtures.FEED_GENERATIONS[0][0]))
    raw = fixtures.render_raw_feed(t, "classic", "iso", "2018-01")
    raw.select(*reversed(raw.columns)).coalesce(1).write.option("header", True).csv(csv_trips.join_path(base, "2018-01"))
    stream = stream_trip_csvs(spark, csv_trips.join_path(base, "*"), schema)
    q = write_trips_stream(stream, fresh_path(spark, "stream-bad"), fresh_path(spark, "stream-bad-ckpt"))
    with pytest.raises(Exception, match="2018-01"):
        q.awaitTermination(120)


def test_table_replace_and_drop(spark):
    t = fixtures.trips(spark, SF)
    name = "cyclestat_test_trips"
    path = fresh_path(spark, name)
    save_table(t, name, path=path)
    save_table(t.limit(5), name, path=path)
    assert read_table(spark, name).count() == 5
    drop_table(spark, name)
    assert not spark.catalog.tableExists(name)


def test_a_failing_replace_leaves_the_old_table(spark):
    name = "cyclestat_test_failing"
    save_table(spark.range(7), name)
    broken = spark.range(5).selectExpr("raise_error('no more rows') AS id", "id AS other")
    for parts in (None, ["other"]):
        try:
            save_table(broken, name, partition_by=parts)
        except Exception as ex:
            assert "no more rows" in str(ex)
        else:
            raise AssertionError("the write did not fail")
        assert read_table(spark, name).count() == 7
    save_table(spark.range(3).selectExpr("id", "id % 2 AS part"), name, partition_by=["part"])
    assert sorted(map(tuple, read_table(spark, name).collect())) == [(0, 0), (1, 1), (2, 0)]
    drop_table(spark, name)


def test_running_reports_equal_batch(spark):
    t, base = _land_feed(spark)
    dirs = [csv_trips.join_path(base, m) for m, _, _ in fixtures.FEED_GENERATIONS]
    schema = csv_trips.master_schema(spark, dirs[0])
    batch = csv_trips.read_trip_csvs(spark, dirs)
    for name, op in (("station_uses", stations.station_uses), ("hourly_usage", usage.hourly_usage)):
        stream = stream_trip_csvs(spark, csv_trips.join_path(base, "*"), schema, max_files_per_trigger=1,
                                  source_column=None)
        out = fresh_path(spark, f"running-{name}")
        q = publish_running(running_report(stream, name), out, fresh_path(spark, f"running-ckpt-{name}"))
        assert latest_version(spark, out + "-none") is None
        q.awaitTermination(180)
        got = latest_version(spark, out)
        want = op(batch)
        assert got.count() == want.count()
        assert got.exceptAll(want.select(*got.columns)).count() == 0


class _Session:
    """What the storage rules look at."""

    def __init__(self, master, **conf):
        self.sparkContext = type("Context", (), {"master": master, "getCheckpointDir": lambda self: None, "setCheckpointDir": lambda self, d: None})()
        self.conf = type("Conf", (), {"get": lambda self, k, default=None: conf.get(k, default)})()


@pytest.mark.parametrize("master, local", [("local", True), ("local[4]", True), ("local[*,3]", True), ("spark://h:7077", False), ("local-cluster[2,1,1024]", False), ("yarn", False)])
def test_only_a_local_master_may_use_local_folders(master, local):
    default = "file:" + os.path.join(os.getcwd(), "spark-warehouse")
    spark = _Session(master, **{"spark.sql.warehouse.dir": default})
    assert scratch.is_local(spark) == local
    if local:
        assert scratch.warehouse_path(spark, "x") == default + "/x" and scratch.checkpoint_root(spark)
    else:
        for use in (scratch.checkpoint_root, scratch.warehouse_path):
            with pytest.raises(ValueError, match="all machines share"):
                use(spark)
        assert scratch.warehouse_path(_Session(master, **{"spark.sql.warehouse.dir": "s3a://b/w/"}), "x") == "s3a://b/w/x"
