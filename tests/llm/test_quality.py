"""Measures against brute force, the binomial bound, and the risk on fresh documents."""

import math
import random
import re
from collections import Counter

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
import pyarrow as pa
from pyspark.sql import functions as F

from cyclestat.llm import quality

WORD = re.compile("[^\x20\x09-\x0d]+")
TEXTS = st.none() | st.lists(st.sampled_from(["a", "b", "é#", " ", "\n", "\r\n", "  \n", "$$", "same line\n", "x y z v w ", "\t", "日", "no!! no!! "]), max_size=50).map("".join)


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), len(lines), text.count("!"), sum(a == b for a, b in zip(words, words[1:])))


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXTS, max_size=8))
def test_measures(texts):
    found = quality.measures(pa.array(texts, pa.string()))
    assert list(zip(*(found[m].tolist() for m in quality.MEASURES))) == [brute(t) for t in texts]


def test_binomial_tail():
    for k, n, p in ((0, 10, 0.1), (3, 10, 0.3), (7, 200, 0.05), (10, 10, 0.4)):
        want = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert quality.binomial_tail(k, n, p) == pytest.approx(want, rel=1e-9)
    assert 0.0 < quality.binomial_tail(4_900, 500_000, 0.01) < 0.5


def test_choice_is_the_strictest_safe_cutoff():
    rules = {"r": ("a", "b", (0.1, 0.2, 0.3))}
    tallies = pd.DataFrame({"stratum": ["x", "few", None], "good": [2_000, 20, 0], "over_r_0": [100, 0, 0], "over_r_1": [2, 0, 0], "over_r_2": [0, 0, 0]})
    (out,) = quality.choose(iter([tallies]), rules, 0.01, 0.05, 9)
    assert out["cut_r"].tolist() == [0.2, math.inf, math.inf]


def documents(spark, seed, n=4_000):
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        good = draw.random() < 0.7
        noise = 0.004 if good else 0.6
        text = " ".join(f"word{draw.randrange(900)}" + ("***" if draw.random() < noise else "") for _ in range(40))
        rows.append((i, text, draw.choice(["s", "t"]), int(good)))
    return spark.createDataFrame(rows, "doc_id long, text string, stratum string, good int")


def test_false_rejections_stay_below_the_risk(spark):
    keep = ["doc_id", "stratum", "good"]
    cuts = quality.cutoffs(quality.measure(documents(spark, 1), keep), F.col("good") == 1, risk=0.04).toPandas()
    assert (cuts["cut_symbols"] < 1.0).all()
    fresh = quality.judged(quality.measure(documents(spark, 2), keep), spark.createDataFrame(cuts)).toPandas()
    fresh["rejected"] = fresh["rejected_by"].map(len) > 0
    good = fresh[fresh["good"] == 1].groupby("stratum")["rejected"].mean()
    assert (good < 0.04).all()
    assert fresh[fresh["good"] == 0]["rejected"].mean() > 0.9


def test_strata_of_few_labels_get_cutoffs(spark):
    """About 700 good labels in each of two strata: too few for one rule at a sixth of the risk."""
    keep = ["doc_id", "stratum", "good"]
    cuts = quality.cutoffs(quality.measure(documents(spark, 3, 2_000), keep), F.col("good") == 1).toPandas()
    assert len(cuts) == 2 and (cuts["cut_symbols"] < 0.2).all()
    fresh = quality.judged(quality.measure(documents(spark, 4), keep), spark.createDataFrame(cuts)).toPandas()
    fresh["rejected"] = fresh["rejected_by"].map(len) > 0
    assert fresh[fresh["good"] == 1]["rejected"].mean() < 0.03
    assert fresh[fresh["good"] == 0]["rejected"].mean() > 0.9


def test_the_path_ends_at_the_first_failure():
    rules = {"r": ("a", "b", (0.1, 0.2, 0.3))}
    tallies = pd.DataFrame({"stratum": ["x"], "good": [2_000], "over_r_0": [0], "over_r_1": [100], "over_r_2": [0]})
    (out,) = quality.choose(iter([tallies]), rules, 0.01, 0.05, 9)
    assert out["cut_r"].tolist() == [0.3]


def test_odd_rows(spark):
    rows = [(1, None, None, 1), (2, "", "s", 1), (2, "", "s", 1), (None, "a # " * 50_000, None, 0), (3, "x" * 500_000, "unlabelled", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, stratum string, n_word long")
    measured = quality.measure(docs, ["doc_id", "stratum", "n_word"])
    cuts = quality.cutoffs(measured, F.col("n_word") == 1)
    got = quality.judged(measured, cuts).collect()
    assert len(got) == len(rows) and all(r.rejected_by == [] for r in got)
    empty = measured.limit(0)
    assert quality.judged(empty, quality.cutoffs(empty, F.lit(True))).collect() == []
    with pytest.raises(ValueError):
        quality.measure(docs.withColumn("n_words", F.lit(1)), ["n_words"])
