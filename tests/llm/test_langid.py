"""Language ID: the forward sum against all segmentations, held-out accuracy, odd rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cyclestat.llm import langid

SYLLABLES = {"aa": ["ka", "to", "mi", "ren"], "bb": ["sch", "un", "ge", "ber"], "cc": ["ção", "es", "lho", "ren"]}


def words(draw, lang, n):
    return " ".join("".join(draw.choice(SYLLABLES[lang]) for _ in range(draw.randint(1, 4))) for _ in range(n))


def corpus(spark, n=300):
    draw = random.Random(4)
    rows = [(i, words(draw, lang, draw.randint(3, 40)), lang) for i in range(n) for lang in [draw.choice(list(SYLLABLES))]]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string")


def segmentations(text, p):
    if not text:
        return 1.0
    return sum(p[text[:n]] * segmentations(text[n:], p) for n in range(1, len(text) + 1) if text[:n] in p)


def test_forward_sums_all_segmentations():
    pieces = ["▁", "▁a", "a", "ab", "abc", "b", "bc", "c", "▁ab"]
    lattice = langid.Lattice(pieces)
    draw = np.random.default_rng(1)
    p = draw.random((len(pieces) + 2, 2))
    p[lattice.none] = 0.0
    for word in ("a", "abc", "aabcb", "cab", "abcabcabc"):
        for at, codes in langid._by_length([word]):
            log, _ = lattice.forward(lattice.find(codes), p, *codes.shape)
            for lang in range(2):
                table = dict(zip(pieces, p[:, lang]))
                assert log[0, lang] == pytest.approx(math.log(segmentations("▁" + word, table)), rel=1e-9)


def test_long_words_do_not_underflow():
    lattice = langid.Lattice(["▁", "a", "aa"])
    p = np.array([[0.1], [1e-9], [1e-12], [1e-6], [0.0]])
    (_, codes), = langid._by_length(["a" * 5_000])
    log, _ = lattice.forward(lattice.find(codes), p, *codes.shape)
    assert np.isfinite(log).all() and log[0, 0] < -50_000


def test_expected_uses_add_up():
    lattice = langid.Lattice(["▁", "▁a", "a", "ab", "b"])
    p = np.array([0.2, 0.2, 0.2, 0.2, 0.2, 1e-6, 0.0])
    uses = lattice.expected(["ab", "b"], np.array([3.0, 1.0]), p)
    length = np.array([1, 2, 1, 2, 1, 1, 0])
    assert (uses * length).sum() == pytest.approx(3 * 3 + 2)


def test_expected_uses_of_long_words_follow_the_rule():
    """Scaled passes give what unscaled ones do, and words of any length teach."""
    lattice = langid.Lattice(["▁", "▁a", "a", "ab", "b", "bab"])
    p = np.array([0.2, 0.1, 0.2, 0.2, 0.2, 0.1, 1e-6, 0.0])
    lengths = np.array([len(x) for x in lattice.pieces] + [1, 0])
    for word in ("ab" * 30, "ba" * 31 + "b", "a" * 3_000):
        uses = lattice.expected([word], np.array([2.0]), p)
        assert np.isfinite(uses).all() and (uses * lengths).sum() == pytest.approx(2 * (len(word) + 1))
    word = "abba"  # all segmentations, the plain way
    ways = {}

    def walk(rest, used, weight):
        if not rest:
            ways[tuple(used)] = weight
        for i, piece in enumerate(lattice.pieces):
            if rest.startswith(piece):
                walk(rest[len(piece) :], [*used, i], weight * p[i])

    walk("▁" + word, [], 1.0)
    want = np.zeros(len(p))
    for used, weight in ways.items():
        np.add.at(want, list(used), weight / sum(ways.values()))
    assert lattice.expected([word], np.array([1.0]), p) == pytest.approx(want, abs=1e-9)


def test_letters_are_of_category_l():
    assert langid._LETTERS.findall("½ ² ① Ⅷ _ 5") == []
    assert langid._LETTERS.findall("a½b çß日本 ʰª") == ["a", "b", "çß日本", "ʰª"]


def test_rare_languages_are_drawn_whole(spark):
    rows, docs = corpus(spark, 400)
    few = spark.createDataFrame([(10_000 + i, "zyx zyyx xyz xyzzy", "rare") for i in range(3)], "doc_id long, text string, lang string")
    model = langid.fit(docs.union(few), sample_rows=40)
    got = langid.predict(few, model, ["doc_id"]).collect()
    assert {r.lang_pred for r in got} == {"rare"}


def test_held_out_accuracy(spark):
    rows, docs = corpus(spark)
    model = langid.fit(docs.where("doc_id % 3 <> 1"))
    got = {r.doc_id: r for r in langid.predict(docs, model, ["doc_id"]).collect()}
    held = [i for i, _, _ in rows if i % 3 == 1]
    assert sum(got[i].lang_pred == rows[i][2] for i in held) / len(held) > 0.98
    assert all(0.0 <= r.score <= 1.0 for r in got.values())


def test_a_sample_of_rows_is_enough(spark):
    rows, docs = corpus(spark)
    model = langid.fit(docs, sample_rows=120)
    got = langid.predict(docs, model, ["doc_id"]).collect()
    assert sum(r.lang_pred == rows[r.doc_id][2] for r in got) / len(got) > 0.95


def test_odd_rows(spark):
    _, docs = corpus(spark, 60)
    model = langid.fit(docs)
    odd = [(1, None), (2, ""), (3, "123 !?"), (4, "katomi " * 40_000), (5, "katomi"), (5, "katomi"), (None, "日本 katomi"), (6, "ka" * 60_000)]
    rows = spark.createDataFrame([(i, t, "x") for i, t in odd], "doc_id long, text string, lang string")
    out = langid.predict(rows, model, ["doc_id", "lang"])
    got = sorted(((r.doc_id or 0, r.lang_pred, r.lang) for r in out.collect()))
    assert got == sorted((i or 0, "und" if i in (1, 2, 3) else "aa", "x") for i, _ in odd)
    assert out.where(~langid.accepted()).count() == 3
    with pytest.raises(ValueError):
        langid.predict(rows.withColumn("score", F.lit(1)), model, ["doc_id", "score"])


def test_no_labels_and_empty_table(spark):
    _, docs = corpus(spark, 6)
    model = langid.fit(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {(r.lang_pred, r.score) for r in langid.predict(docs, model, ["doc_id"]).collect()} == {("und", 0.0)}
    assert langid.predict(docs.limit(0), langid.fit(docs.limit(0)), ["doc_id"]).collect() == []
