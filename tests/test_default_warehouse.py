"""Reports that write files and tables, on a cluster whose warehouse folder was left at its default."""

import datetime as dt
from urllib.parse import unquote, urlsplit

import pytest

from cyclestat.reports import REPORTS
from cyclestat.sources import scratch


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    start = dt.datetime(2024, 1, 1)
    events = [(i, start + dt.timedelta(minutes=i * 97 % 100_000), i % 11, ("purchase", "view")[i % 2], float(i * 7 % 600)) for i in range(400)]
    spark.createDataFrame(events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(f"{at}/events.parquet")
    spark.createDataFrame([(k, f"NATION {k}") for k in range(25)], "n_nationkey int, n_name string").write.parquet(f"{at}/nation.parquet")
    return at


def _rows(df):
    return df.columns, sorted(map(repr, df.collect()))


def _plain(path):
    return "/" + unquote(urlsplit(path).path).lstrip("/")


@pytest.mark.parametrize("name", ["ingest_csv", "ingest_rejects", "trips_table_by_month", "trips_table_ddl", "trips_table_roundtrip"])
def test_files_go_to_the_checkpoint_folder(spark, folder, monkeypatch, name):
    want = _rows(REPORTS[name](spark, folder))
    root = scratch.checkpoint_root(spark)
    monkeypatch.setattr(scratch, "is_local", lambda spark: False)
    got = REPORTS[name](spark, folder)
    assert _rows(got) == want and len(want[1]) > 1
    files = [_plain(f) for f in got.inputFiles()]
    assert files and all(f.startswith(_plain(root) + "/cyclestat/warehouse/") for f in files)
