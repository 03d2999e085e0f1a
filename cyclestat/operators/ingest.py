"""Repair raw trip records (all strings) into the typed trips table."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cyclestat import schema as S
from cyclestat.functions.timeparse import parse_trip_time


def normalise_headers(df: DataFrame, aliases: bool = True) -> DataFrame:
    """Spaces -> ``_`` and lower case on every column name; with ``aliases``
    also map the feed's alternative spellings (``start_time`` ...) to the
    canonical names.  A pure rename: no data is touched."""
    if aliases:
        names = [S.canonical_name(c) for c in df.columns]
    else:
        names = [c.replace(" ", "_").lower() for c in df.columns]
    return df.toDF(*names)


def union_positional(frames: Iterable[DataFrame]) -> DataFrame:
    """UNION ALL by position; names come from the first frame.

    This is how the monthly files line up: their columns are in the same
    order even where the header spelling differs.
    """
    frames = list(frames)
    widths = [len(f.columns) for f in frames]
    if len(set(widths)) > 1:
        raise ValueError(f"union_positional: frames of different width {widths}")
    return reduce(DataFrame.union, frames[1:], frames[0])


def repair_trips(raw: DataFrame) -> DataFrame:
    """Typed trips from an all-string frame with canonical column names.

    Times in any feed layout become ``TIMESTAMP_NTZ`` (see
    :func:`cyclestat.functions.timeparse.parse_trip_time`); coordinates
    become doubles with ``try_cast`` (bad text -> NULL, never a failed job).
    Columns keep their positions; other columns pass through unchanged.
    """
    missing = [c for c in (*S.TIME_COLUMNS, *S.COORDINATE_COLUMNS) if c not in raw.columns]
    if missing:
        raise ValueError(f"repair_trips: missing columns {missing}; normalise headers first")
    fixes = {c: parse_trip_time(c) for c in S.TIME_COLUMNS}
    fixes.update({c: F.col(c).try_cast("double") for c in S.COORDINATE_COLUMNS})
    return raw.withColumns(fixes)


#: Column that says to which output a row of :func:`split_rows` belongs, and its values.
OUTPUT, TRIPS, REJECTS = "ingest_output", "trips", "rejects"
#: Columns of the reject store besides where a row comes from: why, and the text in question.
REASON, TEXT = "reject_reason", "reject_text"
MALFORMED_REASON = "malformed"


def split_rows(raw: DataFrame, malformed: str, always: Sequence[str] = ()) -> DataFrame:
    """Raw rows as the rows of both ingest outputs, made in one pass.

    ``trips``: repaired rows as :func:`repair_trips` makes them, without lines that did not fit the
    schema (column ``malformed``, which goes).  ``rejects``: a row per thing that could not be
    used, with ``reject_reason`` (``malformed``, or the column) and ``reject_text`` (the line, or the cell); columns
    other than ``always`` (e.g. the source file) are NULL there.  A row with an unusable cell is in both: the trip
    counts, its cell is NULL.
    """
    parsed = {c: parse_trip_time(c) for c in S.TIME_COLUMNS}
    parsed.update({c: F.col(c).try_cast("double") for c in S.COORDINATE_COLUMNS})
    bad = F.col(malformed).isNotNull()

    def row(output: str, reason, text) -> Column:
        return F.struct(F.lit(output).alias(OUTPUT), reason.cast("string").alias(REASON), text.cast("string").alias(TEXT))

    kept = F.when(~bad, row(TRIPS, F.lit(None), F.lit(None)))
    line = F.when(bad, row(REJECTS, F.lit(MALFORMED_REASON), F.col(malformed)))
    cells = [F.when(F.col(c).isNotNull() & p.isNull(), row(REJECTS, F.lit(c), F.col(c))) for c, p in parsed.items()]
    outputs = F.array_compact(F.array(kept, line, *cells))
    own = [c for c in raw.columns if c != malformed]
    rows = raw.select(*own, F.inline(outputs))
    trip = F.col(OUTPUT) == TRIPS
    values = {c: parsed[c] if c in parsed else F.col(c) for c in own}
    return rows.select(*[(v if c in always else F.when(trip, v)).alias(c) for c, v in values.items()], OUTPUT, REASON, TEXT)


def reject_counts(trips: DataFrame, rejects: DataFrame, group_by: str) -> DataFrame:
    """:func:`rejects` from the two ingest outputs, both of which have ``group_by``."""
    names = [MALFORMED_REASON, *S.TIME_COLUMNS, *S.COORDINATE_COLUMNS]
    lines = F.when(F.col(REASON) == MALFORMED_REASON, 1)
    per = rejects.groupBy(group_by, REASON).agg(F.count(F.lit(1)).alias("n"), F.count(lines).alias("rows"))
    per = trips.groupBy(group_by).agg(F.count(F.lit(1)).alias("rows")).select(group_by, F.lit(None).cast("string").alias(REASON), F.lit(0).cast("bigint").alias("n"), "rows").unionByName(per)
    counts = [F.sum(F.when(F.col(REASON) == c, F.col("n")).otherwise(0)).alias(c if c == MALFORMED_REASON else f"bad_{c}") for c in names]
    return per.groupBy(group_by).agg(F.sum("rows").alias("rows"), *counts)


def _bad(c: str, parsed: Column) -> Column:
    return F.sum(F.when(F.col(c).isNotNull() & parsed.isNull(), 1).otherwise(0))


def rejects(raw: DataFrame, group_by: str | None = None, malformed: str | None = None) -> DataFrame:
    """What ingest could not use, per ``group_by`` (e.g. the source file), in one pass:
    ``rows``, ``malformed`` (rows whose ``malformed`` column holds the line that did not
    fit the schema; 0 without such a column), and ``bad_<column>`` for each time and
    coordinate: rows whose text is present but unusable."""
    aggs = [F.count(F.lit(1)).alias("rows"),
            (F.count(malformed) if malformed else F.lit(0).cast("bigint")).alias("malformed")]
    aggs += [_bad(c, parse_trip_time(c)).alias(f"bad_{c}") for c in S.TIME_COLUMNS]
    aggs += [_bad(c, F.col(c).try_cast("double")).alias(f"bad_{c}") for c in S.COORDINATE_COLUMNS]
    return raw.groupBy(group_by).agg(*aggs) if group_by else raw.agg(*aggs)


def time_rejects(raw: DataFrame, group_by: str | None = None) -> DataFrame:
    """Rows whose time text is present but unparsable, per ``group_by`` (e.g.
    the source file): (``[group]``, ``rows``, ``bad_starttime``, ``bad_stoptime``)."""
    aggs = [F.count(F.lit(1)).alias("rows")] + [_bad(c, parse_trip_time(c)).alias(f"bad_{c}") for c in S.TIME_COLUMNS]
    return raw.groupBy(group_by).agg(*aggs) if group_by else raw.agg(*aggs)
