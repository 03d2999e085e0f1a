"""Exact top-k search by inner product: columnar branch and bound.

Vectors are dealt into blocks of bounded size.  Each block of queries meets each block of
candidates once, in a task of its own; the candidates lie in vertical layout, a row per
dimension.  For a query the dimensions are taken in order of its largest components, a
few at a time; what the rest can still add or take is at most the product of the two
remaining norms (Cauchy and Schwarz).  Candidates whose upper bound is below the ``k``-th
best lower bound are dropped and the survivors compacted before the next dimensions.
Bounds are widened for rounding, and scores are integers, so the result is exact.  The
best ``k`` of every block are ranked once more per query.

Components are ``floor(scale * x)``.  Vectors that are null or hold null or non-finite
components take no part; vectors meet only those of their own length.  A query does not
meet rows with its own id; rows that repeat another id count each.  Queries that repeat an
id are one (any of its vectors).  Ties go to the smaller id.  Scores must fit 64 bits.
An empty table, or one without queries, gives no rows.  Of the table only the id, the vector and
what the condition names are read, so other columns' names cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cyclestat.llm.common import in_task

_DIMENSIONS = 8


def best_of_block(query: np.ndarray, own: int, columns: np.ndarray, squares: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the ``k`` best candidates; ``columns``: a row per dimension."""
    alive = np.flatnonzero(ids != own)
    score = np.zeros(len(alive), np.int64)
    rest = squares[alive].astype(float)
    order = np.argsort(-np.abs(query), kind="stable")
    left = float((query.astype(float) ** 2).sum())
    for i in range(0, len(order), _DIMENSIONS):
        dims = order[i : i + _DIMENSIONS]
        part = columns[np.ix_(dims, alive)]
        score += query[dims] @ part
        last = i + _DIMENSIONS >= len(order)
        if not last and len(alive) > k:
            rest -= (part.astype(float) ** 2).sum(axis=0)
            left -= float((query[dims].astype(float) ** 2).sum())
            slack = np.sqrt(max(left, 0.0) * np.maximum(rest, 0.0)) * (1 + 1e-9) + 1e-9 * math.sqrt(float(squares.max()) * float((query.astype(float) ** 2).sum())) + 1
            least = np.partition(score - slack, len(alive) - k)[len(alive) - k]
            stay = score + slack >= least
            alive, score, rest = alive[stay], score[stay], rest[stay]
    top = np.lexsort((ids[alive], -score))[:k]
    return ids[alive][top], score[top]


def search_blocks(source: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """A pair of blocks a row, ``queries`` and ``candidates`` as lists of ``id, v``."""

    def block(value: pa.ListScalar) -> tuple[np.ndarray, np.ndarray]:
        rows = value.values
        ids = rows.field("id").to_numpy(zero_copy_only=False)
        return ids, rows.field("v").flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)

    for batch in source:
        for i in range(batch.num_rows):
            query_ids, queries = block(batch.column("queries")[i])
            ids, vectors = block(batch.column("candidates")[i])
            columns = np.ascontiguousarray(vectors.T)
            squares = (vectors.astype(float) ** 2).sum(axis=1)
            found = [(own, *best_of_block(q, own, columns, squares, ids, k)) for own, q in zip(query_ids, queries)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(query_ids, [len(f[1]) for f in found]), pa.int64()),
                    pa.array(np.concatenate([f[1] for f in found]), pa.int64()),
                    pa.array(np.concatenate([f[2] for f in found]), pa.int64()),
                ],
                ["query_id", "vec_id", "score"],
            )


def whole_vectors(table: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """``id, v`` with integer components, of the vectors that take part."""
    x = F.col(vector_col).cast("array<double>")
    usable = x.isNotNull() & F.forall(x, lambda e: F.coalesce(F.abs(e) < float("inf"), F.lit(False)))
    rows = table.where(F.col(id_col).isNotNull()).where(usable)
    return rows.select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda e: F.floor(e * scale)).alias("v"))


def _blocks(rows: DataFrame, most: int, name: str) -> DataFrame:
    """Rows dealt into blocks of about ``most`` by a hash: ``dim, <name>_no, <name>``."""
    n = max(1, math.ceil(rows.count() / most))
    dealt = rows.select(F.size("v").alias("dim"), F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias(f"{name}_no"), F.struct("id", "v").alias("row"))
    return dealt.groupBy("dim", f"{name}_no").agg(F.collect_list("row").alias(name))


def top_k(
    table: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0,
    query_block: int = 512, candidate_block: int = 8192,
) -> DataFrame:
    """``query_id, rank, vec_id, score`` of each query's ``k`` best rows; ``is_query`` is a condition on ``table``."""
    candidates = _blocks(whole_vectors(table, id_col, vector_col, scale), candidate_block, "candidates")
    queries = _blocks(whole_vectors(table.where(is_query), id_col, vector_col, scale).dropDuplicates(["id"]), query_block, "queries")
    numbers = candidates.select("dim", "candidates_no").distinct()
    meet = queries.join(numbers, "dim").join(candidates, ["dim", "candidates_no"])
    meet = meet.select("queries", "candidates").repartition(int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = meet.mapInArrow(in_task("topk", "search_blocks", k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
