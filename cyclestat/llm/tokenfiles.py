"""Token ids as flat binary files with 64-bit document offsets, read through memory maps.

A corpus folder holds shards.  Shard ``k`` covers a range of documents in order and is

* ``ids-k.bin``: its documents' ids one after another, unsigned little-endian integers,
  16 or 32 bits wide (the width follows the vocabulary and is a parameter);
* ``offsets-k.bin``: unsigned 64-bit little-endian, one more than documents: where each
  document begins within the shard and where the last ends;
* ``docs-k.bin``: signed 64-bit ids of the documents in the same order, and
  ``nulls-k.bin``: a byte per document, 1 where the document's id is null;

and ``bases`` (Parquet, a row per shard: ``shard, n_docs, n_tokens, base``) has the number
of tokens of all shards before it, a prefix sum.  ``base + offset`` is a document's place
in the corpus, so no file is rewritten when the sizes of earlier shards become known.

Writing: ids ranges are dealt to tasks (``repartitionByRange``), each task sorts its rows,
encodes and appends as it goes, holding one batch.  Files are written under a name of the
attempt and renamed when complete: a task that is run again, or twice at once, leaves the
same whole files.  The folder must be one that all machines share and mount, as
``spark.checkpoint.dir`` is here (a ``file:`` path).

A null or empty text has the end id alone.  Rows that repeat an id are kept, ordered by
text; a null id comes first.  Texts are encoded whole; one text's ids are what a task holds beside
its batch.  An empty table makes shards without documents and is read back as no rows.  Only
the id and the text are read, so other columns' names cannot clash.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import unquote, urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cyclestat.llm.bpe import Codec, default_vocabulary
from cyclestat.llm.common import in_task
from cyclestat.llm.textbytes import batches

_DOCS_A_READ = 4096


def local_path(folder: str) -> str:
    parts = urlsplit(folder)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"memory maps need a mounted folder, not {folder}")
    return unquote(parts.path)


def _create(folder: str, name: str, attempt: str):
    return open(os.path.join(folder, f".{name}.{attempt}"), "wb")


def write_shard(source: Iterator[pa.RecordBatch], folder: str, vocabulary: str, end_id: int, dtype: str) -> Iterator[pa.RecordBatch]:
    """Rows ``id, text`` of one range, in order, to one shard; yields ``shard, n_docs, n_tokens``."""
    from pyspark import TaskContext

    shard, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
    codec = Codec.of(vocabulary)
    names = [f"{kind}-{shard:06d}.bin" for kind in ("ids", "offsets", "docs", "nulls")]
    os.makedirs(folder, exist_ok=True)
    n_docs = n_tokens = 0
    files = [_create(folder, n, attempt) for n in names]
    try:
        files[1].write(np.zeros(1, "<u8").tobytes())
        for rows in batches(source, "text", 2 << 20):
            ids, counts = codec.encode_column(rows.column("text"))
            ids = np.insert(ids, np.cumsum(counts), end_id)
            if len(ids) and int(ids.max()) > np.iinfo(dtype).max:
                raise ValueError(f"id {ids.max()} does not fit {dtype}")
            files[0].write(ids.astype(dtype).tobytes())
            files[1].write((n_tokens + np.cumsum(counts + 1)).astype("<u8").tobytes())
            column = rows.column("id")
            files[2].write(column.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
            files[3].write(column.is_null().to_numpy(zero_copy_only=False).astype(np.uint8).tobytes())
            n_docs, n_tokens = n_docs + rows.num_rows, n_tokens + len(ids)
    finally:
        for f in files:
            f.close()
    for n in names:
        os.replace(os.path.join(folder, f".{n}.{attempt}"), os.path.join(folder, n))
    yield pa.RecordBatch.from_pydict({"shard": [shard], "n_docs": [n_docs], "n_tokens": [n_tokens]}, schema=pa.schema([("shard", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))


def write_corpus(
    docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end_id: int = 0, dtype: str | None = None
) -> None:
    """Write ``docs`` to ``folder`` (new, shared) in ascending order of ``id_col`` (integers).

    ``dtype``: ``<u2`` or ``<u4``; if not given, the narrower that holds every id.
    """
    spark = docs.sparkSession
    at = local_path(folder)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    dealt = rows.repartitionByRange(n, "id").sortWithinPartitions("id", "text")
    vocabulary = vocabulary or default_vocabulary()
    dtype = dtype or ("<u2" if max(Codec.largest_id(vocabulary), end_id) < 1 << 16 else "<u4")
    args = (at, vocabulary, end_id, dtype)
    dealt.mapInArrow(in_task("tokenfiles", "write_shard", *args), "shard int, n_docs long, n_tokens long").write.parquet(f"{folder}/shards")
    sizes = spark.read.parquet(f"{folder}/shards").where("n_docs > 0")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    based = sizes.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    based.coalesce(1).write.parquet(f"{folder}/bases")
    spark.createDataFrame([(json.dumps({"dtype": dtype, "end_id": end_id}),)], "value string").write.text(f"{folder}/format")


def read_documents(source: Iterator[pa.RecordBatch], folder: str, dtype: str, digest: bool) -> Iterator[pa.RecordBatch]:
    """Rows ``shard, base, lo, hi`` (documents of a shard) to rows of documents."""
    for batch in source:
        for shard, base, lo, hi in zip(*(batch.column(c).to_pylist() for c in ("shard", "base", "lo", "hi"))):
            path = {k: os.path.join(folder, f"{k}-{shard:06d}.bin") for k in ("ids", "offsets", "docs", "nulls")}
            offsets = np.memmap(path["offsets"], "<u8", "r")[lo : hi + 1].astype(np.int64)
            ids = np.memmap(path["ids"], dtype, "r")
            docs = np.memmap(path["docs"], "<i8", "r")[lo:hi]
            nulls = np.memmap(path["nulls"], np.uint8, "r")[lo:hi].astype(bool)
            own = (ids[a:b].astype("<u4").tobytes() for a, b in zip(offsets[:-1], offsets[1:]))
            last = pa.array([zlib.crc32(x) for x in own], pa.int64()) if digest else pa.array(list(own), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(docs, mask=nulls), pa.array(base + offsets[:-1]), pa.array(np.diff(offsets)), last],
                ["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"],
            )


def read_corpus(spark: SparkSession, folder: str, digest: bool = False) -> DataFrame:
    """``doc_id, start, n_tokens`` and ``ids`` (binary, 32 bits each) or, with ``digest``, ``ids_crc32``.

    Blocks of documents are rows, dealt out, so a large shard is read by many tasks.
    """
    fmt = json.loads(spark.read.text(f"{folder}/format").first()[0])
    step = F.lit(_DOCS_A_READ)
    blocks = spark.read.parquet(f"{folder}/bases").withColumn("lo", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_docs") - 1, step.cast("long"))))
    blocks = blocks.select("shard", "base", "lo", F.least(F.col("lo") + step, "n_docs").alias("hi"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    last = "ids_crc32 long" if digest else "ids binary"
    read = in_task("tokenfiles", "read_documents", local_path(folder), fmt["dtype"], digest)
    return blocks.repartition(n, "shard", "lo").mapInArrow(read, f"doc_id long, start long, n_tokens long, {last}")
