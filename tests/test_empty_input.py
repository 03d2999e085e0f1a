"""Every analysis report runs on an empty trips table."""

from pyspark.sql import functions as F

from cyclestat import reports
from cyclestat import schema as S
from cyclestat.operators.sequence import with_next


def test_reports_on_empty_trips(spark):
    empty = spark.createDataFrame([], S.TRIP_SCHEMA)
    for name, fn in reports.ON_TRIPS.items():
        rows = fn(empty).collect()
        if name == "period_scale_limit":
            assert [tuple(r) for r in rows] == [(None, None)], name
        else:
            assert rows == [], name


def test_with_next_on_empty(spark):
    df = spark.createDataFrame([], "id long, k long, o long")
    assert with_next(df, "k", ["o", "id"], ["id"], chunk=F.col("o")).collect() == []
