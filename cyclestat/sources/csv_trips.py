"""Monthly trip CSV files -> one all-string DataFrame -> typed trips.

All files are read by **one** multi-path scan (one task per input split),
not one scan per file followed by a chain of unions.  The explicit all-
string schema, named after the first file's header, is applied to every
file *by position*, so files whose header spells a column differently
(``Start Time`` vs ``starttime``) line up exactly as a positional union
would.  No ``inferSchema`` pass over the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cyclestat import schema as S
from cyclestat.operators.ingest import repair_trips


def join_path(base: str, name: str) -> str:
    """``base/name`` for any Hadoop file system URI (s3a://, hdfs://, file:)."""
    return base.rstrip("/") + "/" + name


# --- fixed values (the feed's object naming) -----------------------------------
# Months up to and including this one are named "YYYY-MM - Citi Bike trip data.csv";
# later months "YYYYMM-citibike-tripdata.csv".
LAST_SPACED_NAME_MONTH = "2014-08"
SPACED_NAME = "{y:04d}-{m:02d} - Citi Bike trip data.csv"
COMPACT_NAME = "{y:04d}{m:02d}-citibike-tripdata.csv"
# -----------------------------------------------------------------------------


def feed_file_names(first_month: str = "2013-07", last_month: str = "2017-07") -> list[str]:
    """Monthly object names of the trip feed, first to last month inclusive."""
    y, m = map(int, first_month.split("-"))
    ly, lm = map(int, last_month.split("-"))
    sy, sm = map(int, LAST_SPACED_NAME_MONTH.split("-"))
    names = []
    while (y, m) <= (ly, lm):
        names.append((SPACED_NAME if (y, m) <= (sy, sm) else COMPACT_NAME).format(y=y, m=m))
        y, m = (y + 1, 1) if m == 12 else (y, m + 1)
    return names


def feed_paths(base: str, first_month: str = "2013-07", last_month: str = "2017-07") -> list[str]:
    """Full paths of the monthly files under ``base`` (any Hadoop FS URI)."""
    return [join_path(base, n) for n in feed_file_names(first_month, last_month)]


#: Column that says which month's feed file a trip came in.
FEED_MONTH = "feed_month"


def feed_month(path: str | Column) -> Column:
    """``yyyy-MM`` of a feed file from its path, in either naming style: from the file's own name, or
    from its folder's where the name has none.  ``unknown`` where neither has one."""
    found = F.regexp_extract(path, r"/(\d{4})-?(\d{2})(?!\d)[^/]*(?:/[^/0-9]*part-[^/]*)?$", 0)
    digits = F.regexp_extract(found, r"^/(\d{4})", 1), F.regexp_extract(found, r"^/\d{4}-?(\d{2})", 1)
    return F.when(found == "", "unknown").otherwise(F.concat_ws("-", *digits))


#: Column of a raw frame that holds a line whose cells do not fit the schema.
MALFORMED = "_malformed"


def file_header(spark: SparkSession, path: str) -> list[str]:
    """Canonical column names of a file's header line; of a folder's first file by name."""
    first = spark.read.format("binaryFile").load(path).agg(F.min("path")).first()[0]  # lists, reads no content
    return [S.canonical_name(h) for h in spark.read.option("header", True).csv(first or path).columns]


def master_schema(spark: SparkSession, first_path: str) -> T.StructType:
    """All-string schema named after the canonical form of one file's header."""
    return T.StructType([T.StructField(h, T.StringType()) for h in file_header(spark, first_path)])


def raw_schema(schema: T.StructType) -> T.StructType:
    """``schema`` as the scan reads it: with a column for lines that do not fit."""
    return T.StructType([*schema.fields, T.StructField(MALFORMED, T.StringType())])


#: Reader options of a scan whose header lines :func:`without_headers` takes out.  A pruned
#: parse would not count the cells of a line.
SCAN_OPTIONS = {"header": False, "columnPruning": False, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": MALFORMED}


def _spellings(name: str) -> list[str]:
    return [name, *[k for k, v in S.HEADER_ALIASES.items() if v == name]]


def without_headers(df: DataFrame, schema: T.StructType, malformed: bool = True, source_column: str | None = None) -> DataFrame:
    """Rows of a scan read with :data:`SCAN_OPTIONS`, header lines out and checked; with their file's path, if asked.

    Every file's header line passes through the scan as a row, so it is compared there, by the
    task that reads it: no job, no second read, however many files a folder or a stream holds.
    A row is a header line if its first time cell does not begin with a digit and at least half of
    its cells are column names of ``schema`` in any spelling.  One that has other columns, or
    another order, ends the read and names the file.  A file without a header line loses no row.
    """
    names = schema.names
    cell = {c: F.col("`" + c.replace("`", "``") + "`") for c in names}
    at = cell[next((c for c in S.TIME_COLUMNS if c in names), names[0])]
    norm = {c: F.lower(F.replace(F.trim(cell[c]), F.lit(" "), F.lit("_"))) for c in names}
    known = [s for c in names for s in _spellings(c)]
    is_name = [F.coalesce(norm[c].isin(known), F.lit(False)).cast("int") for c in names]
    cells = [cell[c].isNotNull().cast("int") for c in names]
    no_time = ~F.coalesce(F.substring(F.trim(at), 1, 1).between("0", "9"), F.lit(False))
    header = no_time & (sum(is_name, F.lit(0)) > 0) & (2 * sum(is_name, F.lit(0)) >= sum(cells, F.lit(0)))
    fits = F.col(MALFORMED).isNull()
    for c in names:
        fits = fits & F.coalesce(norm[c].isin(_spellings(c)), F.lit(False))
    line = F.coalesce(F.col(MALFORMED), F.concat_ws(",", *cell.values()))
    wrong = F.concat(F.col("_metadata.file_path"), F.lit(": columns "), line, F.lit(f" are not those of the first file {','.join(names)}"))
    kept = F.lit(True) if malformed else F.col(MALFORMED).isNull()
    rows = df.where(F.when(header, F.when(fits, F.lit(False)).otherwise(F.raise_error(wrong).cast("boolean"))).otherwise(kept))
    if source_column:
        rows = rows.withColumn(source_column, F.col("_metadata.file_path"))
    return rows if malformed else rows.drop(MALFORMED)


def read_raw_trip_csvs(spark: SparkSession, paths: Sequence[str], source_column: str | None = "source_file",
                       schema: T.StructType | None = None, malformed: bool = True) -> DataFrame:
    """All rows of all files as strings, canonical column names, plus the source file
    path (from the scan's ``_metadata``) when ``source_column``, and ``_malformed``:
    the whole line where it has more or fewer cells than the header, else NULL.
    Without ``malformed`` such lines, and the column, are left out.

    Every file's header line is compared with the first file's by the scan itself
    (:func:`without_headers`), so a file with a shifted or missing column, wherever it lies, stops the read.
    """
    paths = list(paths)
    schema = schema or master_schema(spark, paths[0])
    df = spark.read.schema(raw_schema(schema)).options(**SCAN_OPTIONS).csv(paths)
    return without_headers(df, schema, malformed, source_column)


def read_trip_csvs(spark: SparkSession, paths: Sequence[str], source_column: str | None = None) -> DataFrame:
    """Typed trips table from the monthly CSV files, without malformed lines (see
    :func:`cyclestat.operators.ingest.rejects` for their number)."""
    return repair_trips(read_raw_trip_csvs(spark, paths, source_column=source_column, malformed=False))
