"""Near duplicates against all pairs, chains, copies, hot buckets."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from cyclestat.llm import linking, minhash
from cyclestat.llm.textbytes import Words, mix, shingle_sets

WORD = re.compile("[^\x20\x09-\x0d]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def sets_of(text, n):
    w = WORD.findall(lowered(text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def classes(rows, n, percent):
    """Least reachable id by comparing all pairs; rows with one id are one node."""
    sets = [sets_of(t, n) for _, t in rows]
    parent = {i: i for i, _ in rows}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((top(rows[a][0]), top(rows[b][0])))
                parent[y] = x
    return {i: top(i) for i, _ in rows}


def corpus(seed=5, n_docs=160):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(3_000)]
    passage = [draw.choice(words) for _ in range(60)]
    rows, base = [], [draw.choice(words) for _ in range(90)]
    for i in range(n_docs):
        kind = i % 6
        if kind == 0:  # a chain: each a little further from the first
            base = base.copy()
            base[draw.randrange(len(base))] = draw.choice(words)
            text = " ".join(base)
        elif kind == 1:
            text = " ".join(passage + [draw.choice(words) for _ in range(draw.randint(2, 60))])
        elif kind == 2:
            text = rows[draw.randrange(len(rows))][1].upper() + "  \n"
        elif kind == 3:
            text = " ".join(draw.choice(words[:4]) for _ in range(draw.randint(0, 9)))
        else:
            text = " ".join(draw.choice(words) for _ in range(draw.randint(1, 300)))
        rows.append((1_000 - i, text))
    return rows


@pytest.mark.parametrize("shingle, percent", [(3, 85), (5, 80)])
def test_all_pairs(spark, shingle, percent):
    rows = [*corpus(), (5, ""), (6, " \t"), (7, "a"), (8, "A"), (9, "word " * 30_000), (10, "word " * 30_001), (7, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    rows_a_band = 9 if percent == 85 else 7
    got = minhash.NearDuplicates(shingle, percent, rows_a_band).find(docs).collect()
    want = classes(rows, shingle, percent)
    assert len(got) == len(rows)
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.n_shingles for r in got} == {i: len(sets_of(t, shingle)) for i, t in rows}


def test_nulls(spark):
    docs = spark.createDataFrame([(1, None), (None, "a b c d"), (2, "a b c d"), (3, "A b  c d")], "doc_id long, text string")
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in minhash.NearDuplicates(3, 85).find(docs).collect()}
    assert got == {(1, 0, 1), (None, 2, None), (2, 2, 2), (3, 2, 2)}
    assert minhash.NearDuplicates().find(docs.limit(0)).collect() == []


def test_rows_of_one_id_with_different_texts(spark):
    a, b, c = "one two three four five", "six seven eight nine ten", "other words that stand quite alone"
    rows = [(5, a), (5, b), (3, b), (9, a), (7, c), (7, None), (8, c)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in minhash.NearDuplicates(3, 85).find(docs).collect())
    assert got == [(3, 3, 3), (5, 3, 3), (5, 3, 3), (7, 0, 7), (7, 4, 7), (8, 4, 7), (9, 3, 3)]


def test_hot_group_makes_star_pairs(spark, monkeypatch):
    """Hundreds of near copies: about one pair each, not all pairs."""
    draw = random.Random(2)
    base = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(300):
        own = base.copy()
        own[draw.randrange(400)] = f"x{i}"
        rows.append((i, " ".join(own)))
    seen = []
    links = linking.Linker._links
    monkeypatch.setattr(linking.Linker, "_links", lambda self, pairs, texts: seen.append(pairs.count()) or links(self, pairs, texts))
    got = minhash.NearDuplicates(5, 80).find(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component_id for r in got} == {0}
    assert sum(seen) < 10 * len(rows)


def test_signature_agreement_follows_similarity():
    draw = np.random.default_rng(0)
    same = []
    for size in (7, 40, 900):
        for _ in range(60):
            u = draw.permutation(np.unique(draw.integers(1, 1 << 63, size, dtype=np.uint64)))
            cut = max(1, size // 10)
            sig = minhash.densified([np.sort(u[cut:]), np.sort(u[: len(u) - cut])], 160)
            assert (sig != minhash._EMPTY).all()
            same.append(((sig[0] == sig[1]).mean(), (len(u) - 2 * cut) / len(u)))
    got, want = np.mean(same, axis=0)
    assert abs(got - want) < 0.02


def test_words_and_shingles():
    texts = ["One two\tTHREE", None, "", "é  É ab", "a" * 3_000_000 + " b"]
    words = Words(pa.array(texts), lower=True)
    assert words.counts.tolist() == [3, 0, 0, 3, 2]
    again = Words(pa.array(["x", "ONE", "three", "two É", "a" * 3_000_000]), lower=True)
    assert words.hash[[0, 1, 2, 4, 6]].tolist() == again.hash[[1, 3, 2, 4, 5]].tolist()
    assert [len(s) for s in shingle_sets(words, 3)] == [1, 0, 0, 1, 1]
    assert len(np.unique(mix(np.arange(100_000, dtype=np.uint64)))) == 100_000
