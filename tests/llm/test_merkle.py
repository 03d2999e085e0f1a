"""Merkle manifest against a plain one; every kept level and group size; tampering; odd rows."""

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cyclestat.llm import merkle

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def tree(nodes, arity):
    """Levels from the leaves to the root."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + arity]) for i in range(0, len(out[-1]), arity)])
    return out


def way(levels, at, arity):
    """Siblings of a leaf, level by level."""
    out = []
    for nodes in levels[:-1]:
        run = at - at % arity
        out.append([(i - run, n) for i, n in enumerate(nodes) if run <= i < run + arity and i != at])
        at //= arity
    return out


def plain(rows, arity=3):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append((r[0], leaf(r)))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {g: tree([x for _, x in sorted(groups[g], key=lambda p: (p[0] is not None, p[0] or 0, p[1]))], arity) for g in names}
    top = tree([trees[g][-1][0] for g in names], arity)
    out = []
    for k, g in enumerate(names):
        ids = sorted(groups[g], key=lambda p: (p[0] is not None, p[0] or 0, p[1]))
        for at, (i, x) in enumerate(ids):
            steps = way(trees[g], at, arity) + way(top, k, arity)
            out.append((i, x, trees[g][-1][0], h(*[n for s in steps for _, n in s])))
    return out, top[-1][0] if names else None


def result(manifest):
    rows = manifest.proofs().select("row.id", "node", "subroot", "path").collect()
    assert all(merkle.fold(r.path, r.node) == manifest.root for r in rows)
    return [(r.id, r.node, r.subroot, h((r.path or "").replace("*", "").replace("/", ""))) for r in rows]


def table(sizes, seed=1):
    draw = random.Random(seed)
    rows, at = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            at += draw.randint(1, 3)
            rows.append((at, source, draw.choice(["en", None, ""]), draw.choice([None, 7]), draw.choice(["", None, "a\nb", "ü" * draw.randint(1, 9), "5:x"])))
    draw.shuffle(rows)
    return rows


def order(rows):
    return sorted(rows, key=lambda r: tuple(str(x) for x in r))


@pytest.mark.parametrize("arity, every", [(3, 4), (3, 1), (2, 3), (5, 2)])
def test_every_proof(spark, arity, every):
    rows = table({None: 30, "": 1, "b": arity**every, "a": arity**every + 1, "é": 2, "Z": 250, "hot": 700, "x": 3, "y": 4, "z": 1})
    docs = spark.createDataFrame(rows, SCHEMA).repartition(7)
    manifest = merkle.DatasetManifest(docs, "doc_id", "source", FIELDS, arity=arity, every=every)
    want, root = plain(rows, arity)
    assert manifest.root == root
    assert order(result(manifest)) == order(want)


def test_only_every_few_levels_are_kept(spark):
    docs = spark.range(2_000).selectExpr("id doc_id", "'s' source", "'en' lang", "1L n_chars", "'t' text")
    manifest = merkle.DatasetManifest(docs, "doc_id", "source", FIELDS)
    blocks = [c.selectExpr("size(nodes) n").collect() for c in manifest.groups_tree.checkpoints]
    assert [sum(r.n for r in level) for level in blocks] == [2_000, 25]  # 3 ** 4 = 81 leaves a block
    assert all(r.n <= 81 for level in blocks for r in level)


def test_tampered_documents_are_found(spark):
    rows = table({"a": 60, "b": 11}, seed=4)
    docs = spark.createDataFrame(rows, SCHEMA)
    tampered = merkle.leaf([F.translate(F.col(c), "\n", "") if c == "text" else F.col(c) for c in FIELDS])
    manifest = merkle.DatasetManifest(docs, "doc_id", "source", FIELDS, [tampered.alias("claimed")])
    got = manifest.proofs().select("row.id", "row.claimed", "path").collect()
    broken = {r.id for r in got if merkle.fold(r.path, r.claimed) != manifest.root}
    assert broken == {r[0] for r in rows if r[4] and "\n" in r[4]}


def test_odd_rows(spark):
    rows = [(None, None, None, None, None), (None, None, None, None, None), (5, "s", "en", 1, "same"), (5, "s", "en", 1, "same"), (5, "s", "en", 1, "other"), (6, "s", "en", 1, "x" * 2_000_000), (7, "S", None, None, "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    clash = docs.withColumns({c: F.lit(9) for c in ("node", "row", "tree", "part", "path", "total", "id", "name")})
    manifest = merkle.DatasetManifest(clash, "doc_id", "source", FIELDS)
    want, root = plain(rows)
    assert manifest.root == root and order(result(manifest)) == order(want)
    one = merkle.DatasetManifest(docs.where("doc_id = 7"), "doc_id", "source", FIELDS)
    assert one.root == leaf((7, "S", None, None, "")) and result(one) == [(7, one.root, one.root, h())]
    empty = merkle.DatasetManifest(docs.limit(0), "doc_id", "source", FIELDS)
    assert empty.root is None and empty.proofs().collect() == []


def test_paths_of_a_block():
    nodes = [h(str(i)) for i in range(23)]
    levels = merkle.subtree(nodes, 23, 3, 4)
    assert [len(x) for x in levels] == [23, 8, 3, 1]
    for node, path in zip(nodes, merkle.paths_below(levels, 3, "")):
        assert merkle.fold(path, node) == levels[-1][0]
    assert [len(x) for x in merkle.subtree(nodes, 82, 3, 4)] == [23, 8, 3, 1, 1]  # part of a larger level
