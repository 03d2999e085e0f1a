"""Spelling variants against all pairs of words; slips, chains, odd rows."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cyclestat.llm import spelling

LETTERS = re.compile("[A-Za-zÀ-ÿ]+")


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(counts, ratio=10):
    near = {w: [x for x in counts if one_edit(w, x)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best and counts[best] >= ratio * counts[w] else None
    out = set()
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return out


def plain_counts(rows):
    words = Counter()
    for i, text in rows:
        for run in LETTERS.findall(text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            words[run] += 1
    return {w: n for w, n in words.items() if len(w) >= 7 and n >= 2}


def result(df):
    rows = [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(rows) == len({r[0] for r in rows})
    return set(rows)


def test_all_pairs_of_dense_words(spark):
    draw = random.Random(3)
    words = {"".join(draw.choice("aàb") for _ in range(draw.randint(1, 6))) for _ in range(400)}
    counts = {w: draw.choice([2, 2, 3, 20, 25, 30, 250, 3_000]) for w in words}
    vocabulary = spark.createDataFrame(list(counts.items()), "word string, n long")
    want = plain(counts)
    assert result(spelling.variants(vocabulary)) == want
    assert any(r[2] != r[1] and r[1] for r in want)  # chains of more than one form


def test_documents(spark):
    draw = random.Random(8)
    base = ["".join(draw.choice("abcdeéßxyz") for _ in range(draw.randint(6, 11))) for _ in range(25)]
    rows = []
    for i in range(300):
        words = []
        for _ in range(draw.randint(0, 40)):
            w = draw.choice(base[: 1 + draw.randrange(len(base))])
            if draw.random() < 0.1:
                k = draw.randrange(len(w))
                w = w[:k] + draw.choice(["", "é", w[k] * 2, "Q"]) + w[k + 1 :]
            words.append(draw.choice([w, w.upper() if w.isascii() else w, w.capitalize() if w.isascii() else w]))
        rows.append((i, draw.choice([" ", ", ", "9", "Ā", "_"]).join(words)))
    rows += [(None, "Flächenmaß Flächenmaß"), (400, None), (401, ""), (402, "ÀÀÀÀÀÀÀ ÀÀÀÀÀÀÀ ààààààà ×÷×÷×÷× ×÷×÷×÷×"), (403, "longword" * 20_000), (403, "longword" * 20_000), (404, base[0] + " " + base[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6).withColumn("word", F.lit("clash"))
    counts = plain_counts(rows)
    vocabulary = spelling.counted(spelling.with_slips(spelling.runs(docs)))
    assert {r.word: r.n for r in vocabulary.collect()} == counts
    assert any(n == 2 and len(w) == 160_000 for w, n in counts.items())
    assert result(spelling.variants(vocabulary.where("length(word) < 1000"))) == plain({w: n for w, n in counts.items() if len(w) < 1000})


def test_a_range_is_bounded_by_the_alphabet(spark):
    """All words one letter from another: each range holds a row per letter at most."""
    words = [f"common{a}word" for a in "abcdefghijklmnopqrstuvwxyz"] + ["commonword"]
    vocabulary = spark.createDataFrame([(w, 5 if w != "commonaword" else 70) for w in words], "word string, n long")
    most = spelling.rotations(vocabulary).groupBy("key").count().agg(F.max("count")).first()[0]
    assert most == 27
    got = result(spelling.variants(vocabulary))
    assert got == plain({w: 5 if w != "commonaword" else 70 for w in words})


@pytest.mark.parametrize("word, other", [("aaaaaaab", "aaaaaab"), ("abababab", "abababa"), ("bookkeeper", "bokkeeper"), ("zzzzzzz", "zzzzzzzz")])
def test_runs_of_equal_letters_count_once(spark, word, other):
    vocabulary = spark.createDataFrame([(word, 2), (other, 20)], "word string, n long")
    assert result(spelling.variants(vocabulary)) == {(word, other, other, 2, 1, 20), (other, None, other, 20, 1, None)}


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.variants(spelling.counted(spelling.with_slips(spelling.runs(docs)))).collect() == []
