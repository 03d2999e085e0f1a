"""Catalog tables as a stable name over immutable versions.

Every write makes a version: a new folder, and a table ``<name>__v<time>`` over it.  The name
itself is a view of one version, and switching it is a single catalog call, so a reader finds
the old rows or the new, never none.  A write or a switch that fails leaves the name as it was
and removes what it wrote.

A version may share files with an older one: :func:`replace_parts` writes only the partitions
it is given and points the new version's other partitions at the folders where they are.

Superseded versions stay for readers that began before the switch: the ``keep`` newest versions
(the current one counts), and any that was superseded less than ``older_than`` seconds ago.  Others
go with each write, files included, except folders that a kept version still points at.
"""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from cyclestat.sources.scratch import warehouse_path

#: Versions that stay, the current one included.
KEEP = 2
_VERSION = "__v"
#: How the catalog shows a partition of NULLs (fixed value).
_NULL = "__HIVE_DEFAULT_PARTITION__"


def save_table(df: DataFrame, name: str, path: str | None = None,
               partition_by: Sequence[str] | None = None, fmt: str = "parquet",
               rebalance: bool = True, keep: int = KEEP, older_than: float = 0.0) -> str:
    """Create or replace table ``name`` with ``df``; returns the folder of its files.

    The rows go to a new folder below ``path``, else below the warehouse; then the name
    switches to them (see the module's text).

    ``partition_by`` e.g. a month column lets time-bounded queries prune
    directories.  With ``rebalance`` rows are first rebalanced on the
    partition columns: each writer task then holds few partition values (few
    files), and adaptive execution splits a value that is too large (a month
    holding a third of the data) over several tasks instead of one.  Pass
    ``rebalance=False`` when the input is already clustered by the partition
    columns (monthly feed files: each scan task holds one month), which saves
    a full shuffle.
    """
    parts = list(partition_by or [])
    folder = new_folder(df.sparkSession, name, path)
    _write(df, folder, parts, fmt, rebalance)
    return publish(df.sparkSession, name, df.schema, folder, parts, fmt, keep=keep, older_than=older_than)


def replace_parts(df: DataFrame, name: str, path: str | None = None, rebalance: bool = True,
                  keep: int = KEEP, older_than: float = 0.0) -> str:
    """Replace, in partitioned table ``name``, the partitions of which ``df`` holds rows.

    Only these are written; files of the others are neither read nor copied.  The columns
    must be the table's, in any order.  Returns the folder of the new files.
    """
    spark = df.sparkSession
    schema, parts, fmt = _shape(spark, current_version(spark, name))
    if sorted(df.columns) != sorted(schema.names):
        raise ValueError(f"{name}: columns {df.columns} are not the table's {schema.names}")
    folder = new_folder(spark, name, path)
    _write(df.select(*[df[f.name].cast(f.dataType).alias(f.name) for f in schema.fields]), folder, parts, fmt, rebalance)
    return publish(spark, name, schema, folder, parts, fmt, shared=True, keep=keep, older_than=older_than)


#: Column that deals rows to the tables of :func:`save_outputs`.
OUTPUTS = "ingest_output"


def save_outputs(df: DataFrame, tables: Mapping[str, tuple[str, Sequence[str]]], partition_by: Sequence[str],
                 path: str | None = None, fmt: str = "parquet", replace: bool = False, keep: int = KEEP, older_than: float = 0.0) -> list[tuple]:
    """Several tables from one pass over ``df``: the rows whose ``ingest_output`` is a key of ``tables`` make the
    table of that name with those columns, partitioned by ``partition_by``.  With ``replace`` each
    table's partitions that ``df`` holds no rows of stay (:func:`replace_parts`); a partition of which one
    output has rows is emptied in the others.  Returns the partitions that hold rows."""
    spark, parts = df.sparkSession, list(partition_by)
    folder = new_folder(spark, next(iter(tables.values()))[0], path)
    _write(df, folder, [OUTPUTS, *parts], fmt, False)
    held = spark.read.format(fmt).schema(df.schema).load(folder).select(*parts).distinct()
    made = [tuple(r) for r in held.collect()]  # a row per partition written
    for value, (name, columns) in tables.items():
        schema = T.StructType([df.schema[c] for c in columns])
        publish(spark, name, schema, f"{folder}/{OUTPUTS}={value}", parts, fmt, shared=replace, emptied=made, keep=keep, older_than=older_than)
    return made


def new_folder(spark: SparkSession, name: str, path: str | None = None) -> str:
    """A new folder for a version's files, below ``path`` or the warehouse."""
    base = path.rstrip("/") if path else warehouse_path(spark, name.split(".")[-1])
    return f"{base}/{uuid.uuid4().hex}"


def _write(df: DataFrame, folder: str, parts: Sequence[str], fmt: str, rebalance: bool) -> None:
    if parts and rebalance:
        df = df.hint("rebalance", *parts)
    try:
        df.write.format(fmt).partitionBy(*parts).save(folder)
    except Exception:
        _remove(df.sparkSession, folder)
        raise


def publish(spark: SparkSession, name: str, schema: T.StructType, folder: str, parts: Sequence[str] = (),
            fmt: str = "parquet", shared: bool = False, emptied: Sequence[Sequence] = (),
            keep: int = KEEP, older_than: float = 0.0) -> str:
    """Make the files in ``folder`` the content of ``name``; with ``shared`` the partitions they
    do not hold stay as they are, but for those ``emptied``.  Returns ``folder``."""
    old = current_version(spark, name)
    version = f"{name}{_VERSION}{time.time_ns():020d}_{uuid.uuid4().hex[:6]}"
    fields = [f for f in schema.fields if f.name not in parts] + [schema[p] for p in parts]
    columns = ", ".join(f"{_quoted(f.name)} {f.dataType.simpleString()}" for f in fields)
    by = f"PARTITIONED BY ({', '.join(map(_quoted, parts))})" if parts else ""
    at = quote_identifier(version)
    try:
        _make(spark, folder)
        spark.sql(f"CREATE TABLE {at} ({columns}) USING {fmt} {by} LOCATION {_literal(folder)}")
        if parts:
            spark.catalog.recoverPartitions(version)
            if shared and old:
                types = [schema[p].dataType for p in parts]
                texts = [[None if v is None else str(v) for v in values] for values in emptied]
                own = {*partition_folders(spark, version), *(_spec(parts, values, types) for values in texts)}
                rest = {spec: where for spec, where in partition_folders(spark, old).items() if spec not in own}
                if rest:
                    spark.sql(f"ALTER TABLE {at} ADD " + " ".join(f"PARTITION ({spec}) LOCATION {_literal(where)}" for spec, where in rest.items()))
        if old is None and spark.catalog.tableExists(name):
            drop_table(spark, name)  # a plain table of that name, not made here
        spark.sql(f"CREATE OR REPLACE VIEW {quote_identifier(name)} AS SELECT * FROM {at}")
    except Exception:
        spark.sql(f"DROP TABLE IF EXISTS {at}")
        _remove(spark, folder)
        raise
    expire(spark, name, keep, older_than)
    return folder


def versions(spark: SparkSession, name: str) -> list[str]:
    """The versions of ``name``, oldest first."""
    *db, leaf = name.split(".")
    inside = f" IN {quote_identifier('.'.join(db))}" if db else ""
    pattern = re.compile(re.escape(leaf.lower()) + _VERSION + r"\d{20}_[0-9a-f]{6}")
    found = [r["tableName"] for r in spark.sql(f"SHOW TABLES{inside}").collect()]  # names only
    return sorted(".".join([*db, t]) for t in found if pattern.fullmatch(t))


def current_version(spark: SparkSession, name: str) -> str | None:
    """The version that ``name`` shows, or None if it is no name of versions."""
    if not spark.catalog.tableExists(name):
        return None
    text = [r["data_type"] for r in spark.sql(f"DESCRIBE TABLE EXTENDED {quote_identifier(name)}").collect() if r["col_name"] == "View Text"]
    shown = [v for v in versions(spark, name) if text and text[0].endswith(quote_identifier(v))]
    return shown[0] if shown else None


def expire(spark: SparkSession, name: str, keep: int = KEEP, older_than: float = 0.0) -> list[str]:
    """Remove superseded versions and their files, as the module's text says; returns their names."""
    if keep < 1:
        raise ValueError("the current version stays: keep at least 1")
    now = current_version(spark, name)
    known = [v for v in versions(spark, name) if now is None or v <= now]  # later ones are being made
    # A version is superseded when the next one is made.
    ends = [int(v.rpartition(_VERSION)[2][:20]) for v in known[1:]] + [time.time_ns()]
    gone = [v for v, end in list(zip(known, ends))[:-keep] if time.time_ns() - end >= older_than * 1e9]
    held = {f for v in versions(spark, name) if v not in gone for f in _folders(spark, v)}
    for v in gone:
        used = _folders(spark, v)
        spark.sql(f"DROP TABLE IF EXISTS {quote_identifier(v)}")
        for folder in sorted(used):
            inside = [h for h in held if h == folder or h.startswith(folder + "/")]
            if not inside:
                _remove(spark, folder)
    return gone


def drop_table(spark: SparkSession, name: str) -> None:
    """Drop ``name`` through the SQL entry point, with its versions and their files."""
    kind = spark.catalog.getTable(name).tableType if spark.catalog.tableExists(name) else "VIEW"
    spark.sql(f"DROP {'VIEW' if kind == 'VIEW' else 'TABLE'} IF EXISTS {quote_identifier(name)}")
    for v in versions(spark, name):
        used = _folders(spark, v)
        spark.sql(f"DROP TABLE IF EXISTS {quote_identifier(v)}")
        for folder in used:
            _remove(spark, folder)


def partition_folders(spark: SparkSession, table: str) -> dict[str, str]:
    """Folder of each partition of ``table``, by its spec as SQL (a catalog call per partition)."""
    out = {}
    types = {f.name: f.dataType for f in spark.table(table).schema.fields}
    for row in spark.sql(f"SHOW PARTITIONS {quote_identifier(table)}").collect():
        pairs = [tuple(map(_unescaped, p.partition("=")[::2])) for p in row["partition"].split("/")]
        spec = _spec([k for k, _ in pairs], [None if v == _NULL else v for _, v in pairs], [types[k] for k, _ in pairs])
        told = spark.sql(f"DESCRIBE TABLE EXTENDED {quote_identifier(table)} PARTITION ({spec})").collect()
        out[spec] = next(r["data_type"] for r in told if r["col_name"] == "Location")
    return out


def read_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def quote_identifier(name: str) -> str:
    return ".".join(map(_quoted, name.split(".")))


def _quoted(part: str) -> str:
    return "`" + part.replace("`", "``") + "`"


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _unescaped(part: str) -> str:
    return re.sub("%([0-9A-Fa-f]{2})", lambda m: chr(int(m[1], 16)), part)


def _spec(parts: Sequence[str], values: Sequence[str | None], types: Sequence[T.DataType]) -> str:
    return ", ".join(f"{_quoted(p)} = {_value(v, t)}" for p, v, t in zip(parts, values, types))


def _value(text: str | None, kind: T.DataType) -> str:
    if text is None:
        return "null"
    return _literal(text) if isinstance(kind, (T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType)) else text


def _shape(spark: SparkSession, version: str | None) -> tuple[T.StructType, list[str], str]:
    """Schema, partition columns and format of a version."""
    parts = [c.name for c in spark.catalog.listColumns(version) if c.isPartition] if version else []
    if not parts:
        raise ValueError("only a partitioned table saved here has parts to replace")
    told = spark.sql(f"DESCRIBE TABLE EXTENDED {quote_identifier(version)}").collect()
    return spark.table(version).schema, parts, next(r["data_type"] for r in told if r["col_name"] == "Provider")


def _folders(spark: SparkSession, version: str) -> set[str]:
    """The folders that a version's files are in: its own, or those of its partitions."""
    told = spark.sql(f"DESCRIBE TABLE EXTENDED {quote_identifier(version)}").collect()
    if any(r["col_name"] == "# Partition Information" for r in told):
        return {_plain(f) for f in partition_folders(spark, version).values()}
    return {_plain(r["data_type"]) for r in told if r["col_name"] == "Location"}


def _plain(uri: str) -> str:
    return re.sub("^file:/+", "/", uri).rstrip("/")


def _make(spark: SparkSession, folder: str) -> None:
    """The folder, if nothing was written to it (an output without rows)."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(at)


def _remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of files written here, on whatever file system it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(at, True)
    for _ in range(2):  # a version's folder, or an output's within it, whose last partition went
        at = at.getParent()
        made_here = re.fullmatch(f"[0-9a-f]{{32}}|{OUTPUTS}=.*", at.getName())
        if not made_here or not fs.exists(at) or any(not s.getPath().getName().startswith(("_", ".")) for s in fs.listStatus(at)):
            break
        fs.delete(at, True)
