"""Mixing: targets, sizes of the sample, hot sources, ties, nulls."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cyclestat.llm import mixing

SCHEMA = "doc_id long, text string, source string"


def water(sizes: dict, weights=(1, 2, 3), most=3) -> dict:
    """Targets by sharing again and again, the plain way."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, left, free = {}, float(sum(sizes.values())), set(names)
    while free:
        per = left / sum(w[s] for s in free)
        full = {s for s in free if per * w[s] >= most * sizes[s]}
        if not full:
            return target | {s: per * w[s] for s in free}
        for s in full:
            target[s] = float(most * sizes[s])
            left -= target[s]
        free -= full
    return target


def corpus(spark):
    rows = [(i, "w " * (1 + i * 7 % 40), f"s{min(i % 50, 9)}" if i % 11 else None) for i in range(4_000)]
    rows += [(5_000, None, "s1"), (5_001, "", "s2"), (None, "a b", "s3"), (None, "a b", "s3"), (7_000, "x y z", "tiny"), (3, "again", "s9"), (9_000, None, "void")]
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(7)


@pytest.mark.parametrize("kind", ["one source", "capped"])
def test_no_window_holds_a_source(spark, kind, monkeypatch):
    """Documents due whole copies only are in no order; the others meet in the cut's bin alone."""
    source = F.lit("all") if kind == "one source" else F.when(F.col("id") < 3_000, F.lit("a")).otherwise(F.lit("b"))
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("w w w").alias("text"), source.alias("source"))
    seen = []
    bins = mixing._cut_bin

    def watched(rows, *a):
        seen.append(rows.count())
        return bins(rows, *a)

    monkeypatch.setattr(mixing, "_cut_bin", watched)
    sizes = mixing.document_sizes(docs)
    rows = mixing._with_source(sizes, mixing.source_targets(sizes, (9, 1), 3), "doc_id")
    due = F.col("target") / F.col("source_size")
    rows = rows.withColumn("whole", F.floor(due).cast("long")).withColumn("extra", due - F.floor(due)).withColumn("place", mixing._place("doc_id", 1))
    open_rows = rows.where("extra > 0").count()
    assert open_rows == 0 if kind == "one source" else open_rows < 20_000
    mixing._cuts(rows, "doc_id").collect()
    assert len(seen) == 2 and max(seen) <= 2 * (1 << mixing._LEVEL_BITS)
    got = mixing.mix_documents(docs, weights=(9, 1)).collect()
    assert len(got) == 20_000 and all(0 <= r.copies <= 3 for r in got)


def test_targets_and_sums(spark):
    rows, docs = corpus(spark)
    got = mixing.mix_documents(docs).collect()
    assert len(got) == len(rows)
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.size * r.copies
        largest[r.source] = max(largest[r.source], r.size)
        assert 0 <= r.copies <= 3
    want = water(sizes)
    for r in got:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source], rel=1e-12)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6
    # rows with one id in one source share their fate
    assert len({r.copies for r in got if r.doc_id is None}) == 1


def test_reruns_and_layout_agree(spark):
    _, docs = corpus(spark)
    a = sorted(map(str, mixing.mix_documents(docs).collect()))
    b = sorted(map(str, mixing.mix_documents(docs.repartition(3, "text")).collect()))
    assert a == b


def test_importance_changes_odds_not_sums(spark):
    rows = [(i, "a" if i % 2 else "b", 1 + i % 13, 4.0 if i % 3 == 0 else 1.0) for i in range(3_000)]
    sizes = spark.createDataFrame(rows, "doc_id long, source string, size long, importance double")
    got = mixing.plan_mix(sizes, weights=(3, 1)).toPandas()
    for _, own in got.groupby("source"):
        assert abs((own["size"] * own["copies"]).sum() - own["target"].iloc[0]) <= 7
        mean = own.groupby("importance")["copies"].mean()
        assert mean[4.0] > 1.5 * mean[1.0]


def test_repeated_rows(spark):
    _, docs = corpus(spark)
    docs = docs.withColumn("size", F.lit("clash")).withColumn("target", F.lit(1))
    plan = {(r.doc_id, r.source): r.copies for r in mixing.mix_documents(docs).collect()}
    out = mixing.repeated(docs)
    assert out.columns == docs.columns
    got = defaultdict(int)
    for r in out.collect():
        got[r.doc_id, r.source] += 1
    given = defaultdict(int)
    for r in docs.collect():
        given[r.doc_id, r.source] += 1
    assert {k: v for k, v in got.items()} == {k: n * plan[k] for k, n in given.items() if plan[k]}


def test_empty_and_wordless(spark):
    assert mixing.mix_documents(spark.createDataFrame([], SCHEMA)).collect() == []
    none = mixing.mix_documents(spark.createDataFrame([(1, None, "a"), (2, "", None)], SCHEMA)).collect()
    assert sorted((r.doc_id, r["size"], r.target, r.copies) for r in none) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]


def test_plan_has_no_python(spark):
    _, docs = corpus(spark)
    plan = mixing.mix_documents(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
