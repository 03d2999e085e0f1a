"""Jaccard join by token combinations against all pairs; the prefix rule itself."""

import random

import numpy as np
import pytest

from cyclestat.llm import ngram_join
from test_minhash import classes, corpus, sets_of


@pytest.mark.parametrize("shingle, percent", [(3, 90), (5, 80)])
def test_all_pairs(spark, shingle, percent):
    rows = [*corpus(), (5, ""), (6, " \t"), (7, "a"), (8, "A"), (9, "word " * 30_000), (10, "word " * 30_001), (7, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = ngram_join.JaccardJoin(shingle, percent, slots=1 << 14).find(docs).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.component_id for r in got} == classes(rows, shingle, percent)
    assert {r.doc_id: r.n_shingles for r in got} == {i: len(sets_of(t, shingle)) for i, t in rows}


def test_frequent_tokens(spark, monkeypatch):
    """Every token counts as frequent: pairs and triples alone must find all links."""
    monkeypatch.setattr(ngram_join, "RARE", 1)
    monkeypatch.setattr(ngram_join, "COMMON", 8)
    rows = corpus(seed=11, n_docs=120)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngram_join.JaccardJoin(3, 80, slots=1 << 14).find(docs).collect()
    assert {r.doc_id: r.component_id for r in got} == classes(rows, 3, 80)


def test_nulls_and_repeated_ids(spark):
    docs = spark.createDataFrame([(1, None), (None, "a b c d"), (2, "a b c d"), (3, "A b  c d"), (4, "x y z"), (4, "p q r"), (9, "P Q R")], "doc_id long, text string")
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.JaccardJoin(3, 90).find(docs).collect()}
    assert got == {(1, 0, 1), (None, 2, None), (2, 2, 2), (3, 2, 2), (4, 1, 4), (9, 1, 4)}
    assert ngram_join.JaccardJoin().find(docs.limit(0)).collect() == []
    clash = docs.selectExpr("doc_id", "text", "1 as id", "2 as bucket", "3 as node", "4 as n_shingles")
    assert ngram_join.JaccardJoin(3, 90).find(clash).columns == ["doc_id", "n_shingles", "component_id"]
    with pytest.raises(ValueError):
        ngram_join.JaccardJoin(percent=79)


@pytest.mark.parametrize("percent", [80, 85, 90, 100])
def test_linked_sets_share_a_combination(percent):
    """Random sets of every size at the very threshold, whatever the counters say."""
    draw = np.random.default_rng(percent)
    for trial in range(400):
        n = int(draw.integers(1, 400)) if trial % 3 else int(draw.integers(1, 24))
        x = draw.integers(1, 1 << 63, n, dtype=np.uint64)
        lacks = int(draw.integers(0, n * (100 - percent) // 100 + 1))
        common = x[: n - lacks]
        more = 0  # as many others as the threshold lets y have
        while 100 * len(common) >= percent * (n + more + 1):
            more += 1
        more = int(draw.integers(0, more + 1))
        y = np.concatenate([common, draw.integers(1, 1 << 63, more, dtype=np.uint64)])
        x, y = np.unique(x), np.unique(y)
        if np.array_equal(x, y):
            continue
        table = draw.integers(2, 90, 1 << 14).astype(np.uint8)
        if trial % 2:
            table[draw.random(len(table)) < 0.7] = 80
        row, key = ngram_join.signature_keys([x, y], table, percent)
        both = set(key[row == 0].tolist()) & set(key[row == 1].tolist())
        assert both, (n, lacks, more)


def test_combinations_stay_few():
    draw = np.random.default_rng(3)
    for n in (20, 300, 5_000):
        sets = [np.unique(draw.integers(1, 1 << 63, n, dtype=np.uint64)) for _ in range(5)]
        for level in (10, 40, 90):  # classes 1, 2, 3
            row, key = ngram_join.signature_keys(sets, np.full(1 << 14, level, np.uint8), 90)
            assert len(key) <= 5 * (2.2 * n + 20)


def test_counters_bound_the_counts():
    assert ngram_join.levels(np.array([0, 1, 2, 4, 256, 1 << 40])).tolist() == [0, 1, 5, 9, 33, 161]
    random.seed(1)
    counts = np.arange(1, 5000)
    assert (np.diff(ngram_join.levels(counts).astype(int)) >= 0).all()
