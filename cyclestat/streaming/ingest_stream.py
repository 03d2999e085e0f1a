"""Newly landed monthly CSV files -> typed trips, incrementally."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from cyclestat.operators.ingest import repair_trips
from cyclestat.sources.csv_trips import SCAN_OPTIONS, raw_schema, without_headers


def stream_trip_csvs(spark: SparkSession, source_dir: str, schema: T.StructType,
                     max_files_per_trigger: int | None = None,
                     source_column: str | None = "source_file") -> DataFrame:
    """Streaming typed trips from CSV files arriving in ``source_dir``.

    ``schema`` is the all-string master schema (see
    :func:`cyclestat.sources.csv_trips.master_schema`); as in the batch
    reader it is applied by position, so header spellings do not matter, a file with
    other columns stops the query and malformed lines are left out.
    """
    reader = spark.readStream.schema(raw_schema(schema)).options(**SCAN_OPTIONS)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return repair_trips(without_headers(reader.csv(source_dir), schema, malformed=False, source_column=source_column))


def write_trips_stream(trips: DataFrame, path: str, checkpoint_location: str,
                       available_now: bool = True, partition_by: list[str] | None = None) -> StreamingQuery:
    """Append the stream to a Parquet table at ``path`` (exactly-once through
    the file sink's log and ``checkpoint_location`` on shared storage).
    ``available_now`` processes what has landed, in bounded batches, then stops."""
    w = (trips.writeStream.format("parquet").outputMode("append")
         .option("path", path).option("checkpointLocation", checkpoint_location))
    if partition_by:
        w = w.partitionBy(*partition_by)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()
