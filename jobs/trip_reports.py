"""Production job: monthly trip CSV files -> trips table -> every report.

    spark-submit jobs/trip_reports.py --feed s3a://bucket/trips/ \\
        --first-month 2013-07 --last-month 2017-07 \\
        --table trips --table-path s3a://bucket/warehouse/trips \\
        --out s3a://bucket/reports [--rejects] [--reports station_uses ...]

or ``--paths`` for an explicit list of files/folders.  The feed is read by one
multi-path scan and split in one pass into two Parquet tables, both partitioned by
the feed file's month: the repaired trips, and ``<table>_rejects`` with every line and cell
that could not be used.  Two grouped tables, the path facts and the time facts, are made
from the trips, a part per feed month; every aggregate report is answered from
them and written as Parquet under ``--out/<report>``, so the trips are read twice
whatever the number of reports.  Row sets (copies of the trips with more columns)
are written only when named in ``--reports``.  ``--rejects`` adds a per-file count of
malformed lines, unparsable times and coordinates.

``--update`` takes the given files as new or corrected months of tables that an earlier
run made: their months are replaced in all four tables, trips of no other month are read or
written, and the reports are answered from the facts of all months.

Session settings come from ``spark-submit``; the job sets none.
"""

from __future__ import annotations

import argparse
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

from cyclestat.operators.facts import path_facts, time_facts  # noqa: E402
from cyclestat.operators.ingest import REASON, REJECTS, TEXT, TRIPS, reject_counts, split_rows  # noqa: E402
from cyclestat.reports import ON_PATH_FACTS, ON_TIME_FACTS, ON_TRIPS, ROW_SETS  # noqa: E402
from cyclestat.sources.csv_trips import FEED_MONTH, MALFORMED, feed_month, feed_paths, join_path, read_raw_trip_csvs  # noqa: E402
from cyclestat.sources.tables import read_table, replace_parts, save_outputs, save_table  # noqa: E402

SOURCE = "source_file"


def ingest(spark: SparkSession, paths: list[str], table: str, table_path: str | None, update: bool) -> list[str]:
    """Save or update the trips and rejects tables from the files of ``paths``; returns their months."""
    raw = read_raw_trip_csvs(spark, paths, source_column=SOURCE)
    columns = [c for c in raw.columns if c != MALFORMED]
    rows = split_rows(raw, MALFORMED, always=(SOURCE,)).withColumn(FEED_MONTH, feed_month(SOURCE))
    outputs = {TRIPS: (table, [*columns, FEED_MONTH]), REJECTS: (f"{table}_rejects", [SOURCE, REASON, TEXT, FEED_MONTH])}
    # Feed files hold one month each, so every scan task already writes a
    # single month directory: no rebalance shuffle before the write.
    return sorted(values[0] for values in save_outputs(rows, outputs, [FEED_MONTH], table_path, replace=update))


def run(spark: SparkSession, paths: list[str], table: str, table_path: str | None, out: str,
        reports: list[str] | None = None, rejects: bool = False, update: bool = False) -> list[str]:
    """Ingest ``paths``, save ``table`` (or update months of it), write the reports; returns their names."""
    names = reports or [n for n in ON_TRIPS if n not in ROW_SETS]
    unknown = sorted(set(names) - set(ON_TRIPS))
    if unknown:
        raise ValueError(f"unknown reports {unknown}")
    months = ingest(spark, paths, table, table_path, update)
    trips = read_table(spark, table)
    if rejects:
        counts = reject_counts(trips, read_table(spark, f"{table}_rejects"), SOURCE)
        counts.write.mode("overwrite").parquet(join_path(out, "_ingest_rejects"))
    for kind, facts, answered in (("path_facts", path_facts, ON_PATH_FACTS), ("time_facts", time_facts, ON_TIME_FACTS)):
        name, at = f"{table}_{kind}", f"{table_path}_{kind}" if table_path else None
        if update:
            replace_parts(facts(trips.where(trips[FEED_MONTH].isin(months)), [FEED_MONTH]), name, at)
        else:
            save_table(facts(trips, [FEED_MONTH]), name, at, [FEED_MONTH])
        grouped = read_table(spark, name)
        for report in names:
            if report in answered:
                answered[report](grouped).write.mode("overwrite").parquet(join_path(out, report))
    for name in names:
        if name in ROW_SETS:
            ROW_SETS[name](trips).write.mode("overwrite").parquet(join_path(out, name))
    return names


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    src = ap.add_mutually_exclusive_group(required=True)
    src.add_argument("--feed", help="folder holding the monthly files (feed naming)")
    src.add_argument("--paths", nargs="+", help="explicit CSV files or folders")
    ap.add_argument("--first-month", default="2013-07")
    ap.add_argument("--last-month", default="2017-07")
    ap.add_argument("--table", default="trips")
    ap.add_argument("--table-path", default=None)
    ap.add_argument("--out", required=True)
    ap.add_argument("--reports", nargs="*", default=None)
    ap.add_argument("--rejects", action="store_true")
    ap.add_argument("--update", action="store_true",
                    help="the files are new or corrected months of the saved tables")
    a = ap.parse_args(argv)
    paths = a.paths or feed_paths(a.feed, a.first_month, a.last_month)
    spark = SparkSession.builder.appName("cyclestat-trip-reports").getOrCreate()
    run(spark, paths, a.table, a.table_path, a.out, a.reports, a.rejects, a.update)


if __name__ == "__main__":
    main()
