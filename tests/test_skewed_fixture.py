"""The trips derivation stays exact when one user holds 40% of all events."""

import os

import pytest
from pyspark.sql import functions as F

from compare import compare, duck
from cyclestat.oracle_sql import SQL
from cyclestat.sources import fixtures
from cyclestat.sources.csv_trips import join_path
from cyclestat.sources.scratch import fresh_path

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")


def test_trips_with_a_hot_user_equal_sql_lead(spark):
    d = fresh_path(spark, "skewed")
    ev = fixtures.read_table(spark, SF, "events")
    hot = ev.withColumn("user_id", F.when(F.col("event_id") % 5 < 2, F.lit(-1).cast("bigint"))
                        .otherwise(F.col("user_id")))
    hot.write.parquet(join_path(d, "events.parquet"))
    fixtures.read_table(spark, SF, "nation").write.parquet(join_path(d, "nation.parquet"))
    ok, msg = compare(fixtures.trips(spark, d), duck(d), SQL["trips"])
    assert ok, msg


def test_no_job_runs_when_the_plan_is_made(spark):
    tracker = spark.sparkContext.statusTracker()
    before = len(tracker.getJobIdsForGroup(None))
    events, nation = (fixtures.read_table(spark, SF, t) for t in ("events", "nation"))
    read = len(tracker.getJobIdsForGroup(None))
    fixtures.events_to_trips(events, nation)
    assert len(tracker.getJobIdsForGroup(None)) == read >= before
