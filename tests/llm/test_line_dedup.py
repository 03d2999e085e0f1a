"""Line dedup against brute force, and the levels of the runs."""

import hashlib
import random
from collections import defaultdict

import pytest

from cyclestat.llm import line_dedup

SPACE = " \t\n\x0b\x0c\r"
LONG = "A line that is certainly Long Enough"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def brute(rows, min_chars=20, min_docs=3):
    holders = defaultdict(list)
    for at, (doc_id, text) in enumerate(rows):
        for k in {key(x) for x in (text or "").split("\n")}:
            if len(k) >= min_chars:
                holders[k].append(doc_id)
    out = []
    for doc_id, text in rows:
        kept = []
        lines = (text or "").split("\n")
        for x in lines:
            held = holders.get(key(x), ())
            last = max((d for d in held if d is not None), default=None)
            if len(held) < min_docs or doc_id == last:
                kept.append(x)
        new = "\n".join(kept)
        out.append((doc_id, text if len(kept) == len(lines) else new, len(lines), len(lines) - len(kept)))
    return out


def corpus():
    draw = random.Random(3)
    pool = [LONG, LONG.upper(), "  " + LONG + "\r", "short", "", "É" * 25, "é" * 25, "K" * 30, "k" * 30, "K" * 30, "Kk" * 15, "kK" * 15, "İ" * 22, "i̇" * 22, "x" * 19, "x" * 20, "ΑΣ" * 12, "ας" * 12]
    pool += [f"a shared line number {i} of the pool" for i in range(40)]
    rows = [(i, "\n".join(draw.choice(pool) if draw.random() < 0.6 else f"own line of document {i} {draw.random()}" for _ in range(draw.randint(0, 12)))) for i in range(150)]
    return rows + [(500, None), (501, ""), (502, LONG), (502, LONG), (None, LONG + "\n" + "tail of a null id, long"), (503, "\n\n" + LONG + "\n"), (504, "y" * 200_000 + "\n" + LONG)]


@pytest.mark.parametrize("n_batches, fanout", [(1, 2), (4, 2), (5, 3)])
def test_brute_force(spark, n_batches, fanout):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = line_dedup.drop_repeated_lines(docs, n_batches=n_batches, fanout=fanout).collect()
    assert sorted(map(repr, ((r.doc_id, r.text, r._n_lines, r._n_dropped) for r in got))) == sorted(map(repr, brute(rows)))


def test_extra_columns_stay(spark):
    rows = [(i, LONG, "k", i, "h", 0) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string, drop long, _text_hash string, _id int")
    out = line_dedup.drop_repeated_lines(docs)
    assert out.columns == [*docs.columns, "_n_lines", "_n_dropped"]
    with pytest.raises(ValueError):
        line_dedup.drop_repeated_lines(out)
    assert sorted((r.doc_id, r.text, r.key, r.drop) for r in out.collect()) == [(0, "", "k", 0), (1, "", "k", 1), (2, "", "k", 2), (3, LONG, "k", 3)]


def test_empty_table(spark):
    assert line_dedup.drop_repeated_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_runs_are_levelled(spark):
    runs = line_dedup.LineRuns(spark, 4, fanout=2)
    try:
        shape = []
        for i in reversed(range(5)):
            docs = spark.createDataFrame([(i, f"{LONG}\nonly in document number {i} of five")], "doc_id long, text string")
            runs.add(line_dedup.line_keys(docs).select("id", "keys"))
            shape.append([len(level) for level in runs.levels])
        assert shape == [[1], [0, 1], [1, 1], [0, 0, 1], [1, 0, 1]]
        entries = runs.entries().collect()
        assert sorted(r.n_docs for r in entries) == [1, 1, 1, 1, 1, 5]
        assert {r.last_doc for r in entries if r.n_docs == 5} == {4}
        new = spark.createDataFrame([(9, f"{LONG}\nnever seen before, certainly")], "doc_id long, text string")
        keys = line_dedup.line_keys(new).selectExpr("explode(keys) key")
        assert runs.unseen(keys).count() == 1
        plan = runs.unseen(keys)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "LeftAnti" in plan
    finally:
        runs.close()


def test_query_digest(spark):
    text = "a\nb"
    got = line_dedup.drop_repeated_lines(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert hashlib.sha256(got.text.encode()).hexdigest() == hashlib.sha256(text.encode()).hexdigest()
