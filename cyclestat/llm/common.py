"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import importlib
import os
import re
import sys
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: code points outside ASCII white space.  Fixed by the contracts.
WORD = r"[^\x20\x09-\x0D]+"
#: ASCII white space, as a set of characters for trimming.
SPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path below ``spark.checkpoint.dir``, the folder that driver and executors share.

    Where the session names none, a local master (``local``, ``local[n]``) gets a temporary folder; on a
    cluster that is an error, since other machines could not read it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        base = tempfile.mkdtemp(prefix="cyclestat-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` to shared storage and read it back: computed once, lineage cut, no block to lose."""
    spark, path = df.sparkSession, scratch(df.sparkSession, label)
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def in_task(module: str, name: str, *args) -> Callable:
    """``module.name(iterator, *args)`` as a function for mapInArrow and its like.

    The module is imported inside the task, from the installed package or from
    the folder this package was loaded from, so that what a module keeps (a
    tokenizer, a cache) is there for the worker's next task of that module.  Workers go on
    to other operators' tasks: before a task begins, what other modules keep is let go.
    """
    root = _ROOT

    def run(*data):
        if root not in sys.path:
            sys.path.append(root)
        own = importlib.import_module(f"cyclestat.llm.{module}")
        importlib.import_module("cyclestat.llm.common").release_others(module)
        return getattr(own, name)(*data, *args)

    return run


#: The module whose task this worker ran last, and the modules whose caches another uses.
_last: str | None = None
_USED = {"tokenfiles": {"bpe"}}


def release_others(module: str) -> None:
    """Let go what modules other than ``module`` keep (each by its ``release``), and give memory back."""
    global _last
    if _last == module:
        return
    kept = {module, *_USED.get(module, ())}
    for name, loaded in list(sys.modules.items()):
        if name.startswith("cyclestat.llm.") and name.rpartition(".")[2] not in kept and hasattr(loaded, "release"):
            loaded.release()
    if _last is not None:
        import gc

        import pyarrow as pa

        gc.collect()
        pa.default_memory_pool().release_unused()
        try:  # the allocator keeps freed pages otherwise
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):
            pass
    _last = module


def id_remainder(id_col: str, n: int) -> Column:
    """``crc32(id as text) mod n``: the contracts' deal into learning and held-out rows."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n


def word_count(text: Column) -> Column:
    """Words of ``text``; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
