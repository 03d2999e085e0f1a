"""Log-bilinear scores: base score against brute force, normalisation, learning."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from cyclestat.llm import lm

WORD = re.compile("[^\x20\x09-\x0d]+")


def tokens(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*WORD.findall(lower), None]


def corpus(n=400, seed=1):
    """Sentences of a small grammar: the next word depends on the one before."""
    draw = random.Random(seed)
    nouns, verbs = [f"noun{i}" for i in range(30)], [f"verb{i}" for i in range(30)]
    rows = []
    for i in range(n):
        words = []
        for _ in range(draw.randint(2, 30)):
            words += ["The", draw.choice(nouns), draw.choice(verbs)] + ([f"rare{draw.randrange(10**6)}ly"] if draw.random() < 0.2 else [])
        rows.append((i, " ".join(words)))
    return rows


def test_scores(spark):
    rows = [*corpus(), (1_000, None), (1_001, ""), (1_001, ""), (None, "the unseen wordéé"), (1_002, "the " * 20_000), (1_003, "x" * 300_000)]
    docs = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, n string").repartition(4)
    learning = docs.where("doc_id % 5 <> 1 AND doc_id < 1000")
    fitted = lm.fit(learning, vocab=50, frequent=60, start_rows=100)
    got = lm.score(docs, fitted, ["doc_id", "n"]).collect()
    assert len(got) == len(rows)
    counts = Counter(w for i, t in rows if i is not None and i < 1000 and i % 5 != 1 for w in tokens(t))
    total, distinct = sum(counts.values()), len(counts)
    texts = {}
    for i, t in rows:
        texts[i] = tokens(t)
    for r in got:
        own = texts[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(counts[w] > 0 for w in own), total)
        want = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in own)
        assert r.base_score == pytest.approx(want, rel=1e-9)
        assert r.score < 0.0
    held = [r for r in got if r.doc_id is not None and r.doc_id < 1000 and r.doc_id % 5 == 1]
    assert sum(r.score for r in held) > 0.9 * sum(r.base_score for r in held)  # logs are negative


def test_probabilities_add_up(spark):
    docs = spark.createDataFrame(corpus(120), "doc_id long, text string")
    fitted = lm.fit(docs, vocab=20, frequent=30, start_rows=50)
    table, params, class_sums = fitted.model.value
    model = lm.Model.of_rows(params)
    n = table.n_classes
    for before, before2 in ((n, n), (0, n), (3, 5), (20, 2), (25, 24)):
        every = np.arange(n)
        logs = model.log_probabilities(every, np.full(n, before), np.full(n, before2))
        assert np.exp(logs).sum() == pytest.approx(1.0, rel=1e-9)
    # within a class of other words, all known words and one unknown share it
    known = fitted.counts.toPandas()
    own = set(table.ids[table.classes < table.vocab].tolist()) | {int(lm.END)}
    known = known[~known["id"].isin(own)]
    shares = known.groupby(known["id"] & (lm.OTHERS - 1))["n"].apply(lambda c: (c + 0.5).sum() + 0.5)
    for k, s in shares.items():
        assert s == pytest.approx(class_sums[k])


def test_no_learning_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    fitted = lm.fit(docs.limit(0))
    got = {r.doc_id: r for r in lm.score(docs, fitted, ["doc_id"]).collect()}
    assert (got[1].n_known, got[1].train_tokens, got[1].base_score) == (0, 0, 0.0)
    assert got[1].score == pytest.approx(-3 * math.log10(1023 + 1 + lm.OTHERS), rel=0.3)
    assert lm.score(docs.limit(0), lm.fit(docs), ["doc_id"]).collect() == []


def test_token_ids_and_contexts():
    ids, edges = lm.token_ids(pa.array(["One two", None, "ONE"]))
    assert edges.tolist() == [0, 3, 4, 6]
    assert ids[0] == ids[4] and ids[2] == ids[3] == ids[5] == lm.END
    one, two = lm.contexts(np.array([1, 2, 9, 9, 1, 9]), edges, 77)
    assert one.tolist() == [77, 1, 2, 77, 77, 1]
    assert two.tolist() == [77, 77, 1, 77, 77, 77]
