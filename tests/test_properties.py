"""Property tests: invariants that must hold on any input."""

import datetime as dt

import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cyclestat import schema as S
from cyclestat.functions.timeparse import parse_trip_time
from cyclestat.operators import paths, stations
from cyclestat.operators.sequence import with_next
from cyclestat.sources import fixtures

SF = "/root/testdata/sf0.01"
SLOW = settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_undirected_count_is_sum_of_both_directions(spark):
    t = fixtures.trips(spark, SF)
    directed = {(r[S.START_NAME], r[S.END_NAME]): r["count"]
                for r in t.groupBy(S.START_NAME, S.END_NAME).count().collect()}
    for r in paths.undirected_pair_counts(t).collect():
        a, b = r.station_1, r.station_2
        if a is None:
            continue  # all trips without one of the names
        want = directed.get((a, b), 0) + (directed.get((b, a), 0) if a != b else 0)
        assert r["count"] == want


def test_top_k_is_prefix_of_full_order(spark):
    t = fixtures.trips(spark, SF)
    full = paths.directed_path_counts(t).orderBy(
        F.col("count").desc(), *[F.col(k).asc_nulls_first() for k in paths.DIRECTED_KEYS]).collect()
    top = paths.directed_paths_top(t, 250).collect()
    assert top == full[:250]


def test_results_do_not_depend_on_partitioning(spark):
    t = fixtures.trips(spark, SF)
    shuffled = t.repartition(7, F.rand(seed=3)).sortWithinPartitions(F.rand(seed=4))
    for op in (stations.station_uses, paths.undirected_path_counts, paths.directed_path_counts,
               paths.directed_path_counts_by_period):
        assert _rows(op(t)) == _rows(op(shuffled))


def test_weekday_and_weekend_are_disjoint(spark):
    from cyclestat.operators.calendar import weekday_trips, weekend_trips
    t = fixtures.trips(spark, SF)
    assert weekday_trips(t).select("trip_id").intersect(weekend_trips(t).select("trip_id")).count() == 0


keys = st.one_of(st.none(), st.integers(0, 4))
events = st.lists(st.tuples(keys, st.integers(0, 30), st.one_of(st.none(), st.floats(-5, 5))),
                  min_size=1, max_size=80)


@SLOW
@given(rows=events, width=st.integers(1, 40))
def test_with_next_matches_pandas_shift(spark, rows, width):
    data = [(i, k, o, v) for i, (k, o, v) in enumerate(rows)]
    df = spark.createDataFrame(data, "id long, k long, o long, v double")
    got = {r.id: r.next_v for r in with_next(df, "k", ["o", "id"], ["v"], chunk=F.floor(F.col("o") / width)).collect()}
    pdf = pd.DataFrame(data, columns=["id", "k", "o", "v"]).sort_values(["o", "id"])
    pdf["next_v"] = pdf.groupby(pd.to_numeric(pdf["k"]).fillna(-1), sort=False)["v"].shift(-1)
    want = {int(i): (None if pd.isna(v) else float(v)) for i, v in zip(pdf["id"], pdf["next_v"])}
    assert got == want


stamps = st.datetimes(min_value=dt.datetime(1990, 1, 1), max_value=dt.datetime(2040, 12, 31))


def _render(t: dt.datetime, style: int) -> tuple[str, dt.datetime]:
    if style == 0:
        return t.strftime("%Y-%m-%d %H:%M:%S"), t.replace(microsecond=0)
    if style == 1:
        return t.strftime("%m/%d/%Y %H:%M:%S"), t.replace(microsecond=0)
    if style == 2:
        return f"{t.month}/{t.day}/{t.year} {t.hour}:{t.minute:02d}", t.replace(second=0, microsecond=0)
    return t.strftime("%Y-%m-%d %H:%M:%S.%f"), t.replace(microsecond=0)


@SLOW
@given(items=st.lists(st.tuples(stamps, st.integers(0, 3)), min_size=1, max_size=50))
def test_parser_matches_python_on_all_layouts(spark, items):
    cases = [_render(t, s) for t, s in items]
    df = spark.createDataFrame([(i, txt) for i, (txt, _) in enumerate(cases)], "i int, s string")
    got = {r.i: r.t for r in df.select("i", parse_trip_time("s").alias("t")).collect()}
    assert got == {i: want for i, (_, want) in enumerate(cases)}


@SLOW
@given(text=st.text(alphabet="0123456789/-: .aT", max_size=22))
def test_parser_never_fails_and_accepts_only_valid_text(spark, text):
    got = spark.createDataFrame([(text,)], "s string").select(parse_trip_time("s")).first()[0]
    if got is not None:
        assert ":" in text and (("-" in text) or ("/" in text))
