"""Classes from buckets: stars, blocks, components, hot keys."""

import random
from collections import defaultdict

import numpy as np

from cyclestat.llm import linking
from cyclestat.llm.common import in_task, stored
from test_minhash import classes


def one_bucket(spark, rows, shingle, percent):
    signed = rows.mapInArrow(in_task("ngram_join", "signed_sets", shingle), f"id long, {linking.SIGNED}")
    return linking.Linker(stored(signed, "test-signed"), rows, shingle, percent)


def test_blocks_find_what_stars_miss(spark, monkeypatch):
    """Pairs that meet only in a bucket whose centre is like neither; many blocks a bucket."""
    monkeypatch.setattr(linking, "_BLOCK", 4)
    texts = {}
    draw = random.Random(12)
    common = [f"c{i}" for i in range(60)]
    for g in range(12):
        own = [f"g{g}w{i}" for i in range(40)]
        for k in range(5):
            words = common + own
            words[draw.randrange(60, 100)] = f"x{g}{k}"
            texts[g * 10 + k] = " ".join(words)
    rows = spark.createDataFrame(list(texts.items()), "id long, text string")
    linker = one_bucket(spark, rows, 3, 85)
    got = {r.id: r.component_id for r in linker.classes(linker.members(linker.firsts().selectExpr("1L bucket", "set_a"))).collect()}
    want = classes(list(texts.items()), 3, 85)
    assert got == want and len(set(want.values())) >= 12


def test_similar_blocks():
    draw = np.random.default_rng(5)
    base = draw.choice(200, (40, 60))
    sets = [np.unique(np.where(draw.random(60) < 0.9, base[i % 3], b)).astype(np.uint64) for i, b in enumerate(base)]
    sides = np.array([0] * 15 + [1] * 25)
    for within in (False, True):
        got = set(linking.similar(sets, sides, 70, within))
        want = {(i, j) for i in range(15) for j in range(40) if i != j and (within or j >= 15) and 100 * len(np.intersect1d(sets[i], sets[j])) >= 70 * len(np.union1d(sets[i], sets[j]))}
        assert got == want and want


def test_sketches_rule_out_no_link():
    draw = np.random.default_rng(9)
    sets = []
    for n in [1, 2, 9, 30, 63, 64, 65, 500, 1030, 4000]:
        base = draw.integers(1, 1 << 63, n, dtype=np.uint64)
        for lost in (0, n // 20, n // 11, n // 8, n // 3):
            sets.append(np.unique(np.concatenate([base[lost:], draw.integers(1, 1 << 63, lost // 4, dtype=np.uint64)])))
    bits = linking.bitmaps(sets).to_pylist()
    n = np.array([len(s) for s in sets])
    hopeful = set()
    lengths = linking.by_length(bits)
    for x in lengths.values():
        for y in lengths.values():
            pairs = linking.may_link((n[x], linking._rows(bits, x)), (n[y], linking._rows(bits, y)), 85)
            hopeful |= {(int(x[i]), int(y[j])) for i, j in pairs}
    linked = near = 0
    for i in range(len(sets)):
        for j in range(len(sets)):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 85 * len(np.union1d(sets[i], sets[j])):
                linked += 1
                assert (i, j) in hopeful
            near += len(sets[i]) > 200 and 100 * both < 75 * len(np.union1d(sets[i], sets[j])) and (i, j) in hopeful
    assert linked > 100 and near == 0


def test_components(spark):
    draw = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, x) for x in range(101, 160)] + [(draw.randrange(200, 300), draw.randrange(200, 300)) for _ in range(60)]
    edges = [(a, b) for a, b in edges if a != b]
    got = {r.node: r.root for r in linking.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    for x in near:
        reach, todo = {x}, [x]
        while todo:
            for y in near[todo.pop()] - reach:
                reach.add(y)
                todo.append(y)
        assert got.get(x, x) == min(reach)


def test_components_with_a_hub(spark, monkeypatch):
    """A node with most of the edges is joined by broadcast; chains hang on it."""
    monkeypatch.setattr(linking, "_LEAST_HOT", 8)
    edges = [(1000, x) for x in range(300)] + [(2000 + i, 2001 + i) for i in range(30)] + [(2030, 7), (5000, 4000), (5000, 4001)]
    got = {r.node: r.root for r in linking.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(x, x) == 0 for x in [*range(300), 1000, *range(2000, 2031)])
    assert got[5000] == got[4001] == 4000


def test_hot_keys_are_few_and_not_moved(spark):
    rows = spark.range(40_000).selectExpr("if(id % 3 = 0, -1, id) k", "id v")
    facts = stored(rows.groupBy("k").agg({"*": "count"}).withColumnRenamed("count(1)", "n").selectExpr("k", "n", "k + 1 as next"), "test-facts")
    assert [r.k for r in linking.hot(facts).collect()] == [-1]
    out = linking.join_facts(rows, facts, "k")
    assert out.count() == 40_000 and out.where("next <> k + 1").isEmpty()
    assert "BroadcastHashJoin" in out._jdf.queryExecution().executedPlan().toString()


def test_hot_centre_goes_to_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(linking, "_LEAST_HOT", 16)
    texts = [(i, " ".join([f"w{j}" for j in range(60)] + [f"x{i}"])) for i in range(200)]
    rows = spark.createDataFrame(texts, "id long, text string")
    linker = one_bucket(spark, rows, 3, 90)
    members = linker.members(linker.firsts().selectExpr("1L bucket", "set_a"))
    held = linker._held(members)
    pairs = stored(spark.createDataFrame([(0, i) for i in range(1, 200)], "a long, b long"), "test-pairs")
    links = linker._links(pairs, held)
    assert sorted((r.a, r.b) for r in links.collect()) == [(0, i) for i in range(1, 200)]
    spark.sql(f"DROP TABLE {held}")
