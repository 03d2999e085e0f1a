"""The pipeline against brute force, stage by stage."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np

import corpus_pipeline
from cyclestat.llm import bpe
from cyclestat.llm.common import scratch, stored

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string"
SYLLABLES = {"aa": ["ka", "to", "mi", "ren"], "bb": ["sch", "un", "ge", "ber"]}


def corpus():
    draw = random.Random(9)
    shared = ["this very line is in many documents of the table", "Another LINE, that is shared by several documents"]
    rows = []
    for i in range(240):
        lang = draw.choice(list(SYLLABLES))
        word = lambda: "".join(draw.choice(SYLLABLES[lang]) for _ in range(draw.randint(2, 4)))
        lines = [" ".join(word() for _ in range(draw.randint(3, 25))) for _ in range(draw.randint(1, 5))]
        if i % 4 == 0:
            lines.insert(draw.randrange(len(lines) + 1), draw.choice(shared))
        if i % 9 == 0 and rows:
            lines = draw.choice(rows)[1].upper().split("\n")
        rows.append((i, "\n".join(lines), lang if i % 5 else None, f"s{min(i % 12, 4)}", 0, "x"))
    odd = [(900, None), (901, ""), (902, "12 34"), (903, rows[7][1]), (903, rows[7][1]), (None, rows[8][1]), (904, "ka" * 40_000), (905, "tomi ren " * 9_000)]
    return rows + [(i, t, None, None, None, None) for i, t in odd]


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))


def without_shared_lines(rows):
    holders = defaultdict(list)
    for i, text in rows:
        for k in {key(x) for x in text.split("\n")}:
            if len(k) >= 20:
                holders[k].append(i)
    last = {k: max((i for i in h if i is not None), default=None) for k, h in holders.items() if len(h) >= 3}
    return [(i, "\n".join(x for x in text.split("\n") if key(x) not in last or last[key(x)] == i)) for i, text in rows]


def first_of_classes(rows):
    def shingles(text):
        w = key(text).split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())

    texts = dict(r for r in rows if r[0] is not None)
    sets = {i: shingles(t) for i, t in texts.items()}
    parent = {i: i for i in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    return [(i, texts[i]) for i in texts if top(i) == i] + [r for r in rows if r[0] is None]


def test_stages(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    kept = [(r[0], r[1]) for r in rows if r[0] not in (900, 901, 902)]
    source = {r[0]: r[3] for r in rows}
    expect = [kept, without_shared_lines(kept)]
    expect.append(first_of_classes(expect[1]))
    for (name, stage), want in zip(corpus_pipeline.STAGES, expect):
        out = stage(spark, docs, "unused")
        assert out.columns == docs.columns
        docs = stored(out, f"test-{name}")
        got = Counter((r.doc_id, r.text) for r in docs.collect())
        assert got == Counter(want), name

    name, stage = corpus_pipeline.STAGES[3]
    out = stage(spark, docs, "unused")
    assert out.columns == docs.columns
    mixed = [(r.doc_id, r.text) for r in out.collect()]
    sizes, taken, largest = Counter(), Counter(), Counter()
    for i, t in expect[2]:
        sizes[source[i]] += len(t.split())
        largest[source[i]] = max(largest[source[i]], len(t.split()))
    for i, t in mixed:
        taken[source[i]] += len(t.split())
    assert max(Counter(mixed).values()) <= 3
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, free = {}, set(names)
    while free:
        left = sum(sizes.values()) - sum(target.values())
        each = left / sum(weight[s] for s in free)
        full = {s for s in free if each * weight[s] >= 3 * sizes[s]}
        target |= {s: 3 * sizes[s] for s in full} if full else {s: each * weight[s] for s in free}
        free = free - full if full else set()
    for s in names:
        assert abs(taken[s] - target[s]) <= largest[s] / 2 + 1e-6

    mixed_docs = stored(out, "test-mixed")
    got = corpus_pipeline.encode(spark, mixed_docs, "unused").collect()
    library = bpe.Codec.of(bpe.default_vocabulary()).library
    want = Counter()
    for i, t in mixed:
        ids = library.encode(t, add_special_tokens=False).ids
        packed = np.array(ids, "<u4").tobytes()
        want[i, source[i], len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(t.encode()).hexdigest(), packed] += 1
    assert Counter((r.doc_id, r.source, r.n_tokens, r.ids_sha256, r.decoded_sha256, bytes(r.ids)) for r in got) == want


def test_run_on_a_table(spark):
    folder = scratch(spark, "pipeline-input")
    spark.createDataFrame([r for r in corpus()[:60]], SCHEMA).write.parquet(f"{folder}/documents.parquet")
    first = corpus_pipeline.run(spark, folder)
    again = corpus_pipeline.run(spark, folder)
    assert first.columns == ["doc_id", "source", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    assert first.count() > 0
    assert Counter(map(str, first.collect())) == Counter(map(str, again.collect()))


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "unused")
        assert out.count() == 0
        if name != "encode":
            docs = stored(out, f"test-empty-{name}")


def test_one_row_stays_of_a_repeated_id(spark):
    a, b = "one two three four five six seven", "eight nine ten eleven twelve thirteen"
    rows = [(5, b), (5, a), (5, None), (3, "something else that nobody else has written"), (9, b), (7, None), (7, None), (None, a), (None, a)]
    docs = spark.createDataFrame([(i, t, None, "s", 1, None) for i, t in rows], SCHEMA)
    got = corpus_pipeline.near_dedup(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(5, b), (3, rows[3][1]), (7, None), (None, a), (None, a)], key=str)
