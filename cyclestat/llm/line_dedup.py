"""Removal of lines that many documents share (DataFrame operations only).

A line's key is the line without ASCII white space at its ends and with A-Z in lower
case; keys of at least ``min_chars`` code points count.  What is known about keys is
kept in sorted runs (``LineRuns``): tables of ``key, n_docs, last_doc`` that are dealt
and sorted by key, in levels.  Batches of documents come in falling order of ids.  A
new batch is merge-joined with the runs, which are not dealt again: a key that no run
holds (the anti-join) gets this batch's largest id as its last document, a known key
only adds to the count.  The outcome is a run of its own on level 0; when a level has
``fanout`` runs they are merged into one run of the next level, so ``n`` batches leave
``O(fanout * log n)`` runs and rewrite an entry ``O(log n)`` times.

``drop_repeated_lines`` puts a whole table through the runs batch by batch and then
drops the lines of keys found in ``min_docs`` documents or more, except in the largest
document id that holds the key.

A key is a 64-bit hash of the line's length, its lower-case form and its characters
outside ASCII, which together tell exactly the lines apart that differ after A-Z alone
are lowered.  Hot lines: counts are combined before they are dealt, each key has one
row in a run, and the join of lines with the keys to drop is salted.

A null or empty text is one empty line.  Every row counts as a document of its own;
among rows that repeat one id, all rows of the largest id keep their lines.  A row with
a null id counts as the smallest.  Texts are split whole, whatever their length.  An empty table
gives an empty one.  Columns of the input pass through under any name but ``_n_lines`` and ``_n_dropped``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cyclestat.llm.common import LOWER, SPACE, UPPER, stored

#: Characters outside ASCII whose lower-case form has an ASCII letter (fixed values: U+0130, U+212A).
_ASCII_BELOW = "[İK]"


def line_key(line: Column, min_chars: int = 20) -> Column:
    """Hash of a line's key; null for a key that is too short (or a null line)."""
    core = F.btrim(line, F.lit(SPACE))
    lowered = F.when(core.rlike(_ASCII_BELOW), F.translate(core, UPPER, LOWER)).otherwise(F.lower(core))
    other = F.regexp_replace(core, r"[\x00-\x7f]+", "")
    return F.when(F.length(core) >= min_chars, F.xxhash64(F.length(core), lowered, other))


def split_lines(text: Column) -> Column:
    """The ``\\n``-separated lines of a text; one empty line for null."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20) -> DataFrame:
    """Per row ``id, text_hash, n_lines, keys`` (a key or null for each line)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    keys = F.transform(split_lines(F.col(text_col)), lambda x: line_key(x, min_chars))
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash"), keys.alias("keys"))


class LineRuns:
    """Levelled sorted runs of line keys, kept as bucketed tables of the session's catalog.

    ``n_buckets`` should follow the size of the largest run; ``close`` drops the tables.
    """

    def __init__(self, spark: SparkSession, n_buckets: int, fanout: int = 4) -> None:
        self.spark, self.n_buckets, self.fanout = spark, n_buckets, fanout
        self.levels: list[list[str]] = [[]]

    def _save(self, entries: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        dealt = entries.repartition(self.n_buckets, "key")
        dealt.write.bucketBy(self.n_buckets, "key").sortBy("key").format("parquet").saveAsTable(name)
        return name

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    @property
    def names(self) -> list[str]:
        return [name for level in self.levels for name in level]

    @staticmethod
    def _merged(runs: list[DataFrame]) -> DataFrame:
        merged = runs[0]
        for other in runs[1:]:
            o = other.select(F.col("key").alias("k"), F.col("n_docs").alias("n"), F.col("last_doc").alias("d"))
            merged = merged.hint("merge").join(o, merged["key"] == o["k"], "full").select(
                F.coalesce("key", "k").alias("key"),
                (F.coalesce("n_docs", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("n_docs"),
                F.greatest("last_doc", "d").alias("last_doc"),
            )
        return merged

    def _known(self, batch: DataFrame) -> DataFrame:
        """``batch`` with ``known``: whether a run holds the key.  One merge join a run."""
        batch = batch.withColumn("known", F.lit(False))
        for name in self.names:
            run = self.spark.table(name).select(F.col("key").alias("k"))
            joined = batch.hint("merge").join(run, batch["key"] == run["k"], "left")
            batch = joined.withColumn("known", F.col("known") | F.col("k").isNotNull()).drop("k")
        return batch

    def unseen(self, keys: DataFrame) -> DataFrame:
        """The rows of ``keys`` (a column ``key``) that no run holds: a merge anti-join with each."""
        for name in self.names:
            keys = keys.hint("merge").join(self.spark.table(name).select("key"), "key", "left_anti")
        return keys

    def add(self, keys: DataFrame) -> None:
        """Add a batch (``id, keys``) as a run, then merge every level that is full.

        No id of the batch may be above one of an earlier batch.
        """
        one = keys.select("id", F.explode(F.array_distinct(F.filter("keys", lambda k: k.isNotNull()))).alias("key"))
        batch = one.groupBy("key").agg(F.count(F.lit(1)).alias("n_docs"), F.max("id").alias("last_doc"))
        last = F.when(~F.col("known"), F.col("last_doc")).alias("last_doc")
        self.levels[0].append(self._save(self._known(batch).select("key", "n_docs", last)))
        level = 0
        while len(self.levels[level]) >= self.fanout:
            full = self.levels[level]
            run = self._save(self._merged([self.spark.table(n) for n in full]))
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(run)
            self.levels[level] = []
            self._drop(full)
            level += 1

    def entries(self) -> DataFrame:
        """``key, n_docs, last_doc`` over all batches so far."""
        return self._merged([self.spark.table(n) for n in self.names])

    def close(self) -> None:
        self._drop(self.names)
        self.levels = [[]]


_SALTS = 16


def _batches(keys: DataFrame, n: int) -> Column:
    """Batch number of an id, 0 for the largest ids; cuts are quantiles of all ids."""
    at = [i / n for i in range(n - 1, 0, -1)]
    cuts = keys.agg(F.percentile_approx("id", F.lit(at), F.lit(10_000)).alias("c")).first()["c"] or []
    batch = F.lit(n - 1)
    for i in reversed(range(len(cuts))):
        batch = F.when(F.col("id") > cuts[i], F.lit(i)).otherwise(batch)
    return batch


def lines_to_drop(keys: DataFrame, min_docs: int = 3, n_batches: int = 4, fanout: int = 2) -> DataFrame:
    """Per row with such lines ``id, text_hash, drop`` (positions, from 0); ``keys`` is stored."""
    spark = keys.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    runs = LineRuns(spark, n, fanout)
    batch = _batches(keys, n_batches)
    try:
        for i in range(n_batches):
            runs.add(keys.where(batch == i).select("id", "keys"))
        shared = stored(runs.entries().where(F.col("n_docs") >= min_docs).select("key", "last_doc"), "lines-shared")
    finally:
        runs.close()
    shared = shared.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    lines = keys.select("id", "text_hash", F.posexplode("keys").alias("pos", "key")).where(F.col("key").isNotNull())
    lines = lines.withColumn("salt", F.pmod(F.hash("id", "text_hash"), F.lit(_SALTS)))
    hit = lines.join(shared, ["key", "salt"]).where(~F.col("id").eqNullSafe(F.col("last_doc")))
    return hit.groupBy("id", "text_hash").agg(F.collect_set("pos").alias("drop"))


def drop_repeated_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3, **options
) -> DataFrame:
    """``docs`` with ``text`` replaced, and ``_n_lines`` (before) and ``_n_dropped``.

    A text that loses all its lines becomes empty; a null text stays null.  ``docs`` may
    have columns of any name but these two.  ``options``: ``n_batches``, ``fanout``.
    """
    if clash := {"_n_lines", "_n_dropped"} & set(docs.columns):
        raise ValueError(f"columns {sorted(clash)} are made here; rename them first")
    keys = stored(line_keys(docs, id_col, text_col, min_chars), "lines-keys")
    drop = lines_to_drop(keys, min_docs, **options)
    drop = drop.select(F.col("id").alias("_id"), F.col("text_hash").alias("_hash"), F.col("drop").alias("_drop"))
    whole = docs.select(
        F.struct(*docs.columns).alias("_doc"), F.col(id_col).alias("_own"), F.col(text_col).alias("_text"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_text_hash")
    )
    both = whole.join(drop, whole["_own"].eqNullSafe(drop["_id"]) & (whole["_text_hash"] == drop["_hash"]), "left")
    lines = split_lines(F.col("_text"))
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_drop"))
    kept = F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")
    text = F.when(F.col("_drop").isNotNull(), kept).otherwise(F.col("_text"))
    return both.select(
        *[text.alias(c) if c == text_col else F.col("_doc")[c].alias(c) for c in docs.columns],
        F.size(lines).cast("long").alias("_n_lines"),
        F.coalesce(F.size("_drop"), F.lit(0)).cast("long").alias("_n_dropped"),
    )
