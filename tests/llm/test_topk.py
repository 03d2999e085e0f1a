"""Exact top-k against brute force: ties, copies, nulls, odd lengths."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from cyclestat.llm import topk

SCHEMA = "vec_id long, embedding array<float>, score long, rank string"


def brute(rows, k):
    usable = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, own in {i: v for i, v in usable if i % 50 == 0}.items():
        found = sorted((-sum(a * b for a, b in zip(own, v)), i) for i, v in usable if i != q and len(v) == len(own))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found[:k])]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, "clash") for i, v in rows], SCHEMA).repartition(4)


def search(spark, rows, k=5, **blocks):
    got = topk.top_k(table(spark, rows), F.col("vec_id") % 50 == 0, k, **blocks).collect()
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got)


def test_brute_force_over_many_blocks(spark):
    draw = random.Random(8)
    rows = [(i, [draw.gauss(0, 1) for _ in range(24)]) for i in range(700)]
    rows += [(1_000 + i, rows[3][1]) for i in range(120)]  # a common vector
    rows += [(2_000 + i, [float(i % 3), 0.0]) for i in range(60)]  # another length, many ties
    assert search(spark, rows) == brute(rows, 5)
    assert search(spark, rows, query_block=4, candidate_block=90) == brute(rows, 5)


def test_odd_rows(spark):
    rows = [(0, [1.0, -1.0]), (50, None), (100, [1.0, None]), (150, [float("nan"), 1.0]), (200, [float("inf"), 1.0]), (None, [1.0, 1.0]), (3, [0.5, 0.25]), (250, [-2.0, 3.0]), (300, []), (4, []), (3, [0.5, 0.25]), (350, [1e7, -1e7])]
    assert search(spark, rows) == brute(rows, 5)
    assert search(spark, []) == []
    assert search(spark, [(0, [1.0])]) == []


def test_bounds_drop_candidates_but_lose_none():
    draw = np.random.default_rng(3)
    vectors = draw.integers(-200, 200, (3_000, 64)) * (draw.random((3_000, 1)) < 0.1) + draw.integers(-5, 6, (3_000, 64))
    ids = np.arange(3_000)
    columns, squares = np.ascontiguousarray(vectors.T), (vectors.astype(float) ** 2).sum(axis=1)
    for q in range(0, 300, 10):
        got = topk.best_of_block(vectors[q], q, columns, squares, ids, 5)
        score = vectors @ vectors[q]
        want = sorted((-score[i], i) for i in ids if i != q)[:5]
        assert [(-s, i) for i, s in zip(*got)] == want
