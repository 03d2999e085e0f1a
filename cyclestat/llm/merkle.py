"""Merkle manifest of a dataset: digests of documents, groups and the whole, and proofs of each.

Trees.  A document's digest is its leaf.  The leaves of a group stand in the order of their
documents' ids; every ``arity`` consecutive nodes of a level (the last run may be shorter, even
one) make a node of the next, until one is left, the group's subroot.  The subroots, in the
order of their groups (null first, bytewise), make a tree of their own, whose root stands for
the dataset.  Digests are SHA-256 as lower-case hexadecimal text, of their inputs as text.

Places.  Documents are dealt to ranges of (group, id, leaf); counts of (group, range) and prefix
sums over the ranges give each leaf its place.  No task holds a group: a group is many ranges.

Checkpoints.  Only every ``every``-th level is kept, as blocks: the ``arity ** every`` consecutive
nodes below one node of the next kept level, with which they form an aligned subtree.  A block
is climbed in one task, which gives up all levels between.  A kept level has
``arity ** -every`` times the nodes of the one below, so they come to little more than the leaves.

Proofs go down from the root.  For each block, joined with the path of the node above it, the
nodes between are computed again from the kept ones, every node below gets its path, and
the nodes between are forgotten.  A join takes a row per block, never one per leaf.

A path is text: a level after the other from the leaf up, separated by ``/``; a level holds the
digests of its run from left to right, ``*`` in the node's own place.  Whoever has a document
and its path can fold them to the root without the manifest.

Results.  Null fields count as ``-``, so a null differs from an empty text.  Documents with the same id
stand in the order of their leaves; a null id comes first.  Equal rows are leaves of their
own, whose order makes no difference.  A text of any length is digested whole where it is read; only digests
go on.  An empty table has no rows and the root None.  Columns that are not named as fields take no part;
results are built from the given names only, so other columns' names cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cyclestat.llm.common import in_task, stored

#: Blocks whose paths are held at once in a task.
_BLOCKS_AT_ONCE = 16


def digest(*texts: str) -> str:
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def leaf(fields: list[Column]) -> Column:
    """Digest of a document: of each field ``-`` if null, else UTF-8 bytes, ``:``, value."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]).cast("binary"), 256)


def above(nodes: list[str], arity: int) -> list[str]:
    return [digest(*nodes[i : i + arity]) for i in range(0, len(nodes), arity)]


def subtree(nodes: list[str], total: int, arity: int, every: int) -> list[list[str]]:
    """The levels over a block of a level of ``total`` nodes, itself first: ``every`` more, or up to the tree's root."""
    out = [nodes]
    while len(out) <= every and total > 1:
        out.append(above(out[-1], arity))
        total = -(-total // arity)
    return out


def paths_below(levels: list[list[str]], arity: int, path: str) -> list[str]:
    """The path of each node of the lowest level, given that of the node on top."""
    paths = [path]
    for nodes in reversed(levels[:-1]):
        wider = []
        for j in range(len(nodes)):
            run = nodes[j - j % arity : j - j % arity + arity]
            level = "".join([*run[: j % arity], "*", *run[j % arity + 1 :]])
            up = paths[j // arity]
            wider.append(f"{level}/{up}" if up else level)
        paths = wider
    return paths


def fold(path: str | None, node: str) -> str:
    """The root that ``node`` and its path lead to."""
    for level in path.split("/") if path else []:
        node = digest(level.replace("*", node))
    return node


def climb(source: Iterator[pa.RecordBatch], arity: int, every: int) -> Iterator[pa.RecordBatch]:
    """Blocks ``tree, block, total, nodes`` to the node on top of each: ``tree, at, total, node``."""
    for batch in source:
        total = batch.column("total").to_pylist()
        tops = [subtree(nodes, n, arity, every)[-1][0] for nodes, n in zip(batch.column("nodes").to_pylist(), total)]
        left = pa.array([-(-n // arity**every) for n in total], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("tree"), batch.column("block"), left, pa.array(tops, pa.string())], ["tree", "at", "total", "node"])


def descend(source: Iterator[pa.RecordBatch], arity: int, every: int) -> Iterator[pa.RecordBatch]:
    """Blocks with the path and subroot of the node above: ``tree, at, node, path, subroot`` of each node, and its ``row``."""
    for whole in source:
        for i in range(0, whole.num_rows, _BLOCKS_AT_ONCE):
            batch = whole.slice(i, _BLOCKS_AT_ONCE)
            tree, at, node, path, subroot = [], [], [], [], []
            columns = [batch.column(c).to_pylist() for c in ("tree", "block", "total", "nodes", "path", "subroot")]
            for t, block, total, nodes, up, top in zip(*columns):
                path += paths_below(subtree(nodes, total, arity, every), arity, up)
                tree += [t] * len(nodes)
                subroot += [top] * len(nodes)
                at += range(block * arity**every, block * arity**every + len(nodes))
                node += nodes
            arrays = [pa.array(tree, pa.int64()), pa.array(at, pa.int64()), pa.array(node, pa.string()), batch.column("rows").flatten(), pa.array(path, pa.string()), pa.array(subroot, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, ["tree", "at", "node", "row", "path", "subroot"])


def folded(source: Iterator[pa.RecordBatch], node_col: str) -> Iterator[pa.RecordBatch]:
    """Rows with their ``folded`` root for the digest in ``node_col``, and ``proof`` for the digest of the siblings; no ``path``."""
    for batch in source:
        paths = batch.column("path").to_pylist()
        roots = [fold(p, n) for p, n in zip(paths, batch.column(node_col).to_pylist())]
        proofs = [digest((p or "").replace("*", "").replace("/", "")) for p in paths]
        kept = [c for c in batch.schema.names if c != "path"]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(roots, pa.string()), pa.array(proofs, pa.string())], [*kept, "folded", "proof"])


class Manifest:
    """The kept levels of the trees over ``leaves`` (``tree, at, total, node, row``): ``checkpoints``, ``roots``."""

    def __init__(self, leaves: DataFrame, arity: int = 3, every: int = 4) -> None:
        self.arity, self.every = arity, every
        self.checkpoints: list[DataFrame] = []
        self.whole = leaves.where("total = 1")
        roots = self.whole.select("tree", "total", "node", F.lit(0).alias("level"))
        level = leaves
        while True:
            open_ = level.where("total > 1")
            width = arity**every
            by = open_.groupBy("tree", F.floor(F.col("at") / width).alias("block"), "total")
            inside = F.array_sort(F.collect_list(F.struct("at", "node", "row")))
            blocks = by.agg(inside.alias("b")).select("tree", "block", "total", F.col("b.node").alias("nodes"), F.col("b.row").alias("rows"))
            blocks = stored(blocks, f"merkle-level-{every * len(self.checkpoints)}")
            if blocks.isEmpty():
                break
            self.checkpoints.append(blocks)
            up = blocks.select("tree", "block", "total", "nodes").mapInArrow(in_task("merkle", "climb", arity, every), "tree long, at long, total long, node string")
            level = stored(up.withColumn("row", F.lit(None).cast("int")), "merkle-tops")
            roots = roots.union(level.where("total = 1").select("tree", "total", "node", F.lit(len(self.checkpoints)).alias("level")))
        #: ``tree, total, node, level``: each tree's root, and the kept level on which it stands.
        self.roots = stored(roots, "merkle-roots")

    def proofs(self, above: DataFrame) -> DataFrame:
        """``row, node, path, subroot`` of every leaf; ``above`` (``tree, path``): where each tree's root stands."""
        ends = stored(above.join(self.roots, "tree").select("tree", F.lit(0).cast("long").alias("at"), "path", F.col("node").alias("subroot"), "level"), "merkle-ends")
        paths = None
        for i in reversed(range(len(self.checkpoints))):
            blocks = self.checkpoints[i]
            over = ends.where(F.col("level") == i + 1).drop("level")
            over = over if paths is None else over.unionByName(paths)
            kind = blocks.schema["rows"].dataType.elementType.simpleString()
            rows = blocks.join(over.withColumnRenamed("at", "block"), ["tree", "block"])
            out = rows.mapInArrow(in_task("merkle", "descend", self.arity, self.every), f"tree long, at long, node string, row {kind}, path string, subroot string")
            if i == 0:
                paths = out.select("row", "node", "path", "subroot")
            else:
                paths = stored(out.select("tree", "at", "path", "subroot"), "merkle-paths")
        alone = self.whole.join(ends.where("level = 0").select("tree", "path", "subroot"), "tree").select("row", "node", "path", "subroot")
        return alone if paths is None else paths.unionByName(alone)


class DatasetManifest:
    """Trees per group of ``docs`` and the tree over them.

    ``others``: further columns of ``docs``, expressions of given names, that go with each proof.
    """

    def __init__(self, docs: DataFrame, id_col: str, group_col: str, fields: list[str], others: list[Column] = (), arity: int = 3, every: int = 4) -> None:
        rows = docs.select(F.col(group_col).alias("name"), F.col(id_col).alias("id"), leaf([F.col(c) for c in fields]).alias("node"), F.struct(F.col(id_col).alias("id"), *others).alias("row"))
        n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = stored(rows.repartitionByRange(n, "name", "id", "node").withColumn("part", F.spark_partition_id()), "merkle-dealt")
        counts = stored(dealt.groupBy("name", "part").agg(F.count(F.lit(1)).alias("n")), "merkle-counts")
        # Groups: those that begin in lower ranges, then the place among those that begin in this one.
        groups = counts.groupBy("name").agg(F.min("part").alias("first"), F.sum("n").alias("total"))
        begin = groups.groupBy("first").agg(F.count(F.lit(1)).alias("k"))
        lower = Window.orderBy("first").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
        begin = begin.select("first", F.coalesce(F.sum("k").over(lower), F.lit(0)).alias("lower"))
        place = F.col("lower") + F.row_number().over(Window.partitionBy("first").orderBy("name")) - 1
        self.groups = stored(groups.join(begin, "first").select("name", place.cast("long").alias("tree"), "total"), "merkle-groups")
        earlier = Window.partitionBy("name").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
        starts = counts.select("name", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
        g = self.groups.withColumnRenamed("name", "_name")
        starts = starts.join(g, F.col("name").eqNullSafe(F.col("_name"))).select("_name", F.col("part").alias("_part"), "start", "tree", "total")
        placed = dealt.join(starts, F.col("name").eqNullSafe(F.col("_name")) & (F.col("part") == F.col("_part")))
        nth = F.row_number().over(Window.partitionBy("name", "part").orderBy("id", "node")) - 1
        leaves = placed.select("tree", (F.col("start") + nth).alias("at"), "total", "node", "row")
        self.groups_tree = Manifest(stored(leaves, "merkle-leaves"), arity, every)
        tops = self.groups_tree.roots.join(self.groups.select("tree"), "tree")
        several = F.lit(self.groups.count()).cast("long")
        tops = stored(tops.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("at"), several.alias("total"), "node", F.struct(F.col("tree").alias("group")).alias("row")), "merkle-subroots")
        self.top = Manifest(tops, arity, every)
        root = self.top.roots.first()
        #: The dataset's digest; None without documents.
        self.root: str | None = root["node"] if root else None

    def proofs(self) -> DataFrame:
        """``row`` (the id and the others), ``node`` (leaf), ``path``, ``subroot`` of every document."""
        spark = self.groups.sparkSession
        end = spark.createDataFrame([(0, "")], "tree long, path string")
        over = self.top.proofs(end).select(F.col("row.group").alias("tree"), "path")
        return self.groups_tree.proofs(over)
