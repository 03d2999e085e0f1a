"""Classes of similar documents from buckets of candidates: stars, proofs, components, blocks.

What the similarity operators share.  They differ in how documents come to meet in buckets;
here each bucket's members are compared on their full sets and linked ones are joined.

Nodes.  Rows with equal sets are one node from the start, known by its least id.  Where an id
has rows with different sets, nodes are known by id and set, and an edge joins the nodes of
one id.  A set is known by its size and two 64-bit sums of its shingles' 64-bit hashes; full
sets are sets of these hashes, so two shingles are taken as one with probability 2 ** -64.

Stars.  In each bucket the least member is the centre, one candidate edge to every other
member, so a group of ``m`` near copies costs about ``m`` pairs.  A star can miss a link
between two members that are not like its centre.  So buckets whose members are still in
several components go on: the members outside the bucket's largest component meet all
others, in blocks of bounded size, compared within tasks that return a link for each two
components only.  No pair of a bucket is given up, none within a component is looked at again.

Bitmaps.  Before texts are sent, sketches decide: of each set, every hash flips one of a number of
bits (a power of two, two to four times the size).  The bits in which two sketches differ are at
most the hashes in which the sets differ, so a pair beyond the bound is no link, for certain; what
stays is near the threshold and is proven on full sets.  A sketch has about a hundredth of a
text's bytes.  Blocks are first compared so, and only members left with a partner send texts.

Hot keys.  A key that holds more than a fixed share of all rows (a bucket, a centre, a hub) is
never dealt by that key: there are few such keys, by the share, and they are joined by
broadcast or dealt by a second key.

All steps are joins and aggregates over tables; only counts reach the driver.  Tables that are
used again are written to shared storage.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cyclestat.llm.common import in_task, stored
from cyclestat.llm.textbytes import Words, batches, mix, shingle_sets

#: What a set is known by.
SAME = ["n_shingles", "set_a", "set_b"]
#: What a document's signature holds beside its id and what makes its buckets.
SIGNED = "n_shingles long, set_a long, set_b long, bits binary"
#: Members of a block of texts and of a block of sketches, on average; columns of a product.
_BLOCK, _SKETCHES, _COLUMNS = 512, 2048, 4096
#: Words of sketches that are compared at once.
_AT_ONCE = 1 << 22
#: A key is never hot with fewer rows than this.
_LEAST_HOT = 512


def set_sums(sets: list[np.ndarray]) -> tuple[pa.Array, pa.Array]:
    """Two 64-bit sums of each set's hashes; with the size they tell sets apart."""
    a = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
    b = np.array([mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
    return pa.array(a), pa.array(b)


def bitmaps(sets: list[np.ndarray]) -> pa.Array:
    """Of each set the parities of its hashes' counts in a power of two of bits, 64 at least."""
    out = []
    for s in sets:
        size = max(64, 1 << int(2 * len(s) - 1).bit_length()) if len(s) else 64
        odd = np.bincount(((s * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)).astype(np.int64) & (size - 1), minlength=size) & 1
        out.append(np.packbits(odd.astype(bool)).tobytes())
    return pa.array(out, pa.binary())


def folded_to(bits: np.ndarray, words: int) -> np.ndarray:
    """Sketches (rows of 64-bit words) as they would be with fewer bits: the halves' parities."""
    while bits.shape[1] > words:
        half = bits.shape[1] // 2
        bits = bits[:, :half] ^ bits[:, half:]
    return bits


def may_link(left: tuple, right: tuple, percent: int) -> np.ndarray:
    """Pairs ``(i, j)`` of two lists of sizes and sketches (one length each) that the sketches do not rule out."""
    (n, a), (m, b) = left, right
    words = min(a.shape[1], b.shape[1])
    a, b = folded_to(a, words), folded_to(b, words)
    out = []
    step = max(1, _AT_ONCE // max(1, len(b) * words))
    for i in range(0, len(a), step):
        differ = np.bitwise_count(a[i : i + step, None, :] ^ b[None, :, :]).sum(axis=2, dtype=np.int64)
        both = n[i : i + step, None] + m[None, :]
        small, great = np.minimum(n[i : i + step, None], m[None, :]), np.maximum(n[i : i + step, None], m[None, :])
        fits = ((100 + percent) * differ <= (100 - percent) * both) & (100 * small >= percent * great)
        x, y = np.nonzero(fits)
        out.append(np.stack([x + i, y], axis=1))
    return np.concatenate(out) if out else np.zeros((0, 2), np.int64)


def by_length(bits: list[bytes]) -> dict[int, np.ndarray]:
    """Indices of sketches of each length in bytes."""
    length = np.array([len(x) for x in bits])
    return {int(k): np.flatnonzero(length == k) for k in np.unique(length)}


def _rows(bits: list[bytes], some: np.ndarray) -> np.ndarray:
    return np.frombuffer(b"".join(bits[i] for i in some), np.uint64).reshape(len(some), -1)


def hopeful_pairs(source: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows ``a, b, n_a, n_b, bits_a, bits_b``: the pairs ``a, b`` that the sketches do not rule out."""
    for batch in source:
        x, y = batch.column("bits_a").to_pylist(), batch.column("bits_b").to_pylist()
        both = (batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()).astype(np.int64)
        differ = np.zeros(len(x), np.int64)
        for i, (p, q) in enumerate(zip(x, y)):
            p, q = np.frombuffer(p, np.uint64)[None], np.frombuffer(q, np.uint64)[None]
            words = min(p.shape[1], q.shape[1])
            differ[i] = np.bitwise_count(folded_to(p, words) ^ folded_to(q, words)).sum()
        fits = (100 + percent) * differ <= (100 - percent) * both
        yield batch.select(["a", "b"]).filter(pa.array(fits))


def hopeful_members(source: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows ``bucket, kind, p, q, side, node, root, n, bits`` sorted by block: ``bucket, node`` of members
    with a partner of another root in their block that the sketches do not rule out."""
    key, held = None, []
    schema = None

    def left() -> pa.RecordBatch:
        side = np.array([h[0] for h in held])
        number: dict = {}
        root = np.array([number.setdefault(str(h[2]), len(number)) for h in held])
        n, bits = np.array([h[3] for h in held], np.int64), [h[4] for h in held]
        within = key[1] == 0 and key[3] == 0
        some = np.zeros(len(held), bool)
        lengths = by_length(bits)
        for k, x in lengths.items():
            for other in (k // 2, k, 2 * k):  # linked sets' sizes are less than an octave apart
                y = lengths.get(other)
                x0, y1 = x[side[x] == 0], None if y is None else (y if within else y[side[y] == 1])
                if y is None or not len(x0) or not len(y1):
                    continue
                pairs = may_link((n[x0], _rows(bits, x0)), (n[y1], _rows(bits, y1)), percent)
                i, j = x0[pairs[:, 0]], y1[pairs[:, 1]]
                apart = root[i] != root[j]
                some[i[apart]] = some[j[apart]] = True
        chosen = [h[1] for h, take in zip(held, some) if take]
        return pa.RecordBatch.from_arrays([pa.array([key[0]] * len(chosen), schema.field("bucket").type), pa.array(chosen, schema.field("node").type)], ["bucket", "node"])

    for batch in source:
        schema = batch.schema
        for *at, side, node, root, n, bits in zip(*(batch.column(c).to_pylist() for c in ("bucket", "kind", "p", "q", "side", "node", "root", "n", "bits"))):
            if at != key:
                if key is not None:
                    yield left()
                key, held = at, []
            held.append((side, node, root, n, bits))
    if key is not None:
        yield left()


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def hot(facts: DataFrame) -> DataFrame:
    """The keys of ``facts`` (a row per key, ``n`` its rows) with over a quarter of a task's share.

    At most four per shuffle partition can have that many, so they can be broadcast.
    """
    total = facts.agg(F.sum("n")).first()[0] or 0
    return F.broadcast(facts.where(F.col("n") > max(_LEAST_HOT, total // (4 * partitions(facts)))))


def join_facts(rows: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """``rows`` with their key's row of ``facts`` (stored; ``n``: the key's number of rows); hot keys are not moved."""
    few = hot(facts)
    rest = rows.join(few.select(key), key, "left_anti").join(facts.join(few.select(key), key, "left_anti"), key)
    return rows.join(few, key).unionByName(rest).drop("n")


def confirmed(source: Iterator[pa.RecordBatch], shingle: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Rows ``a, part, b, text`` sorted by ``a, part, b``, the centre first (null ``b``): linked ``a, b``."""
    centre, own = None, None
    for batch in batches(source, "text"):
        sets = shingle_sets(Words(batch.column("text"), lower=True), shingle)
        groups = list(zip(batch.column("a").to_pylist(), batch.column("part").to_pylist()))
        left, right = [], []
        for group, b, s in zip(groups, batch.column("b").to_pylist(), sets):
            if b is None:
                centre, own = group, s
            elif group == centre:
                common = len(np.intersect1d(own, s, assume_unique=True))
                if 100 * common >= percent * (len(own) + len(s) - common):
                    left.append(group[0])
                    right.append(b)
        ids = batch.schema.field("a").type
        yield pa.RecordBatch.from_arrays([pa.array(left, ids), pa.array(right, ids)], ["a", "b"])


def linked_blocks(source: Iterator[pa.RecordBatch], shingle: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Rows ``bucket, kind, p, q, side, root, text`` sorted by block to links ``a, b`` of roots."""
    key, sides, roots, sets = None, [], [], []
    kind = None

    def links() -> pa.RecordBatch:
        number = {}
        root = np.array([number.setdefault(str(r), len(number)) for r in roots])
        found = {}
        for i, j in similar(sets, np.array(sides), percent, key[1] == 0 and key[3] == 0):
            if root[i] != root[j]:
                found[min(root[i], root[j]), max(root[i], root[j])] = (roots[i], roots[j])
        pairs = list(found.values())
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], kind), pa.array([p[1] for p in pairs], kind)], ["a", "b"])

    for batch in batches(source, "text"):
        kind = batch.schema.field("root").type
        own = shingle_sets(Words(batch.column("text"), lower=True), shingle)
        columns = [batch.column(c).to_pylist() for c in ("bucket", "kind", "p", "q", "side", "root")]
        for *at, side, root, s in zip(*columns, own):
            if at != key:
                if key is not None:
                    yield links()
                key, sides, roots, sets = at, [], [], []
            sides.append(side)
            roots.append(root)
            sets.append(s)
    if key is not None:
        yield links()


def similar(sets: list[np.ndarray], sides: np.ndarray, percent: int, within: bool) -> Iterator[tuple[int, int]]:
    """Pairs of sets of side 0 and side 1 (and, if asked, of side 0) that are similar enough.

    Common elements are counted by products of incidence matrices, a few columns at a time.
    """
    left, right = np.flatnonzero(sides == 0), np.flatnonzero(sides == 1)
    if within:
        right = np.concatenate([left, right])
    size = np.array([len(s) for s in sets])
    _, column, uses = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), size)
    row, column = row[uses[column] > 1], column[uses[column] > 1]
    order = np.argsort(column, kind="stable")
    row, column = row[order], np.unique(column[order], return_inverse=True)[1]
    common = np.zeros((len(left), len(right)), np.float32)
    edges = np.searchsorted(column, np.arange(0, (column[-1] if len(column) else -1) + 1 + _COLUMNS, _COLUMNS))
    for a, b in zip(edges[:-1], edges[1:]):
        held = np.zeros((len(sets), _COLUMNS), np.float32)
        held[row[a:b], column[a:b] % _COLUMNS] = 1.0
        common += held[left] @ held[right].T
    both = size[left][:, None] + size[right][None, :]
    for i, j in zip(*np.nonzero((100 * common >= percent * (both - common)) & (common > 0))):
        if left[i] != right[j]:
            yield int(left[i]), int(right[j])


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for edges ``a, b``: the least node reachable.  Large star, small star, repeated.

    A node's least neighbour is an aggregate combined before the shuffle; a hub's edges stay where they are.
    """
    now = stored(edges.select("a", "b").distinct(), "graph")
    while True:
        near = now.selectExpr("a u", "b v").union(now.selectExpr("b u", "a v"))
        least = stored(near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n")), "graph-least")
        large = join_facts(near.where("v > u"), least, "u").selectExpr("v u", "m v").where("u <> v").distinct()
        large = stored(large, "graph-large")
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = join_facts(large, stored(low, "graph-least"), "u")
        small = small.selectExpr("u", "m v").union(small.selectExpr("v u", "m v")).where("u <> v").distinct()
        now = stored(small.selectExpr("u a", "v b"), "graph")
        # Done when all that is left are stars: no node has two roots or is one itself.
        ends = now.selectExpr("a k", "1 leaf").union(now.selectExpr("b k", "0 leaf").distinct())
        if ends.groupBy("k").agg(F.sum("leaf").alias("n"), F.min("leaf").alias("r")).where("n > 1 OR (n = 1 AND r = 0)").isEmpty():
            return now.selectExpr("a node", "b root")


class Linker:
    """Documents' sets as nodes, and the classes of nodes that meet in buckets.

    ``signed``: a row per document, ``id, n_shingles, set_a, set_b, bits`` and whatever makes its
    buckets, stored; ``texts``: ``id, text``.
    """

    def __init__(self, signed: DataFrame, texts: DataFrame, shingle: int, percent: int) -> None:
        self.shingle, self.percent, self.signed, self.texts = shingle, percent, signed, texts
        known = signed.where("n_shingles > 0 AND id IS NOT NULL")
        several = known.groupBy("id").agg(F.min(F.struct(*SAME)).alias("lo"), F.max(F.struct(*SAME)).alias("hi")).where("lo <> hi")
        #: Whether an id has rows with different sets; then ids alone do not name nodes.
        self.mixed = not several.isEmpty()
        name = F.struct("id", *SAME) if self.mixed else F.col("id")
        self.rows = known.withColumn("name", name)
        self.sets = stored(self.rows.groupBy(*SAME).agg(F.min("name").alias("node"), F.first("bits").alias("bits")), "sets")

    def firsts(self) -> DataFrame:
        """The rows of ``signed`` that name a node: one per set, but for repeated rows."""
        return self.rows.drop("bits").join(self.sets.select(F.col("node").alias("name"), *SAME), ["name", *SAME], "left_semi")

    def members(self, rows: DataFrame) -> DataFrame:
        """``bucket, set_a`` of documents or nodes to ``bucket, node, n`` of buckets with several sets.

        A set's first sum alone finds its node; where two sets share it, both are taken as members.
        """
        facts = rows.groupBy("bucket").agg(F.min("set_a").alias("lo"), F.max("set_a").alias("hi"), F.count(F.lit(1)).alias("n"))
        several = stored(facts.where("lo < hi").select("bucket", "n"), "buckets")
        met = join_facts(rows.select("bucket", "set_a"), several, "bucket").distinct()
        return stored(met.join(self.sets.selectExpr("set_a", "node", "n_shingles n"), "set_a").select("bucket", "node", "n"), "members")

    def classes(self, members: DataFrame) -> DataFrame:
        """``id, n_shingles, component_id`` for each row of ``signed``; see the module's text."""
        held = self._held(members)
        try:
            roots = self._compare(members, held)
        finally:
            self.signed.sparkSession.sql(f"DROP TABLE IF EXISTS {held}")
        rooted = self.sets.join(roots, "node", "left").select(*SAME, F.coalesce("root", "node").alias("root"))
        out = self.signed.join(rooted, SAME, "left")
        root = F.col("root.id") if self.mixed else F.col("root")
        component = F.when(F.col("id").isNotNull(), F.coalesce(root, "id"))
        if self.mixed:  # rows of one id are one document, whatever their sets
            least = out.groupBy("id").agg(F.min(component).alias("component_id"))
            out = out.join(least, out["id"].eqNullSafe(least["id"]), "left").drop(least["id"])
            return out.select("id", "n_shingles", F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"))
        return out.select("id", "n_shingles", component.alias("component_id"))

    def _held(self, members: DataFrame) -> str:
        """``node, text`` of the members as a table bucketed by node: joins on it do not move it again."""
        used = members.select("node").distinct()
        texts = self.texts.where("id IS NOT NULL")
        if self.mixed:  # a row's set decides which node it is
            own = texts.mapInArrow(in_task("linking", "summed", self.shingle), f"id {texts.schema['id'].dataType.simpleString()}, text string, n_shingles long, set_a long, set_b long")
            texts = own.join(used.select("node", "node.*"), ["id", *SAME]).select("node", "text").dropDuplicates(["node"])
        else:
            texts = texts.withColumnRenamed("id", "node").join(used, "node", "left_semi")
        name, n = f"linking_{uuid.uuid4().hex}", partitions(texts)
        texts.repartition(n, "node").write.bucketBy(n, "node").sortBy("node").format("parquet").saveAsTable(name)
        return name

    def _with_text(self, rows: DataFrame, node: str, held: str) -> DataFrame:
        table = self.signed.sparkSession.table(held)
        return rows.join(table, rows[node] == table["node"])

    def _links(self, pairs: DataFrame, held: str) -> DataFrame:
        """The pairs ``a, b`` whose full sets are similar enough.  A hot centre's pairs go to many tasks."""
        few = hot(stored(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")), "centres"))
        parted = F.when(F.col("n").isNotNull(), F.pmod(F.hash("b"), F.lit(4 * partitions(pairs)))).otherwise(0)
        dealt = pairs.join(few, "a", "left").select("a", "b", parted.alias("part"))
        nothing = F.lit(None).cast(pairs.schema["b"].dataType).alias("b")
        centres = self._with_text(dealt.select("a", "part").distinct(), "a", held).select("a", "part", nothing, "text")
        others = self._with_text(dealt, "b", held).select("a", "part", "b", "text")
        rows = centres.union(others).repartition("a", "part").sortWithinPartitions("a", "part", F.asc_nulls_first("b"))
        kind = pairs.schema["a"].dataType.simpleString()
        return rows.mapInArrow(in_task("linking", "confirmed", self.shingle, self.percent), f"a {kind}, b {kind}")

    def _hopeful(self, pairs: DataFrame) -> DataFrame:
        """The pairs ``a, b`` that the sketches do not rule out."""
        known = self.sets.select("node", F.col("n_shingles").alias("size"), "bits")
        centres = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")).join(known, F.col("a") == F.col("node"))
        centres = stored(centres.select("a", "n", F.col("size").alias("n_a"), F.col("bits").alias("bits_a")), "centre-sketches")
        rows = join_facts(pairs, centres, "a").join(known.select(F.col("node").alias("b"), F.col("size").alias("n_b"), F.col("bits").alias("bits_b")), "b")
        kind = pairs.schema["a"].dataType.simpleString()
        return rows.select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(in_task("linking", "hopeful_pairs", self.percent), f"a {kind}, b {kind}")

    def _star(self, members: DataFrame, centres: DataFrame) -> DataFrame:
        """Candidate pairs ``a, b``: each bucket's least member with the others of like size."""
        near = F.expr(f"node > centre AND 100 * least(n, cn) >= {self.percent} * greatest(n, cn)")
        rows = join_facts(members.withColumnRenamed("n", "size"), centres, "bucket").withColumnRenamed("size", "n")
        return rows.where(near).selectExpr("centre a", "node b").distinct()

    def _rooted(self, members: DataFrame, centres: DataFrame, roots: DataFrame) -> DataFrame:
        """``bucket, node, root`` of the members that stars have not compared with all others: all but the centres."""
        rest = join_facts(members.select("bucket", "node"), centres, "bucket").where("node > centre").select("bucket", "node")
        return rest.join(roots, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root"))

    def _open(self, rooted: DataFrame, most: int) -> DataFrame:
        """``bucket, node, root`` and their block, for the buckets not yet in one component.

        Block ``(0, p, q)`` holds members outside the largest component (part ``p``, side 0)
        and inside it (part ``q``, side 1); ``(1, p, q)`` two parts of the former.
        """
        each = rooted.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n"))
        sizes = each.groupBy("bucket").agg(F.max_by("root", "n").alias("main"), F.max("n").alias("n_main"), F.sum("n").alias("n"))
        sizes = sizes.where("n > n_main").select(
            "bucket", "main", "n", F.ceil(F.col("n_main") / most).cast("int").alias("mains"), F.ceil((F.col("n") - F.col("n_main")) / most).cast("int").alias("others")
        )
        state = stored(join_facts(rooted, stored(sizes, "open-sizes"), "bucket").withColumn("inside", F.col("root") == F.col("main")), "open")
        part = F.pmod(F.hash("node"), F.when(F.col("inside"), F.col("mains")).otherwise(F.col("others")))
        state = state.withColumn("part", part)
        block = lambda kind, p, q, side: F.struct(F.lit(kind).alias("kind"), p.alias("p"), q.alias("q"), side.alias("side"))
        counter = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
        own = F.col("part")
        within = F.transform(counter("others"), lambda i: block(0, i, own, F.lit(1)))
        outside = F.concat(
            F.transform(counter("mains"), lambda i: block(0, own, i, F.lit(0))),
            F.transform(F.filter(counter("others"), lambda i: i != own), lambda i: block(1, F.least(i, own), F.greatest(i, own), (i < own).cast("int"))),
        )
        return state.select("bucket", "node", "root", F.explode(F.when(F.col("inside"), within).otherwise(outside)).alias("at")).select("bucket", "at.*", "node", "root")

    def _left(self, blocks: DataFrame) -> DataFrame:
        """``bucket, node`` of the members that the sketches leave with a partner in a block."""
        key = ["bucket", "kind", "p", "q"]
        known = self.sets.select("node", F.col("n_shingles").alias("n"), "bits")
        rows = blocks.join(known, "node").select(*key, "side", "node", "root", "n", "bits").repartition(*key).sortWithinPartitions(*key)
        kind = rows.schema["node"].dataType.simpleString()
        return rows.mapInArrow(in_task("linking", "hopeful_members", self.percent), f"bucket long, node {kind}").distinct()

    def _met(self, blocks: DataFrame, held: str) -> DataFrame:
        """Links ``a, b`` between components that meet in a block."""
        key = ["bucket", "kind", "p", "q"]
        rows = self._with_text(blocks.withColumnRenamed("node", "own"), "own", held).select(*key, "side", "root", "text").repartition(*key).sortWithinPartitions(*key)
        kind = rows.schema["root"].dataType.simpleString()
        return rows.mapInArrow(in_task("linking", "linked_blocks", self.shingle, self.percent), f"a {kind}, b {kind}").distinct()

    def _compare(self, members: DataFrame, held: str) -> DataFrame:
        """``node, root`` of the nodes that are linked with a lesser one."""
        centres = members.groupBy("bucket").agg(F.min(F.struct("node", F.col("n").alias("size"))).alias("c"), F.count(F.lit(1)).alias("n"))
        centres = stored(centres.selectExpr("bucket", "c.node centre", "c.size cn", "n"), "bucket-centres")
        pairs = stored(self._hopeful(stored(self._star(members, centres), "pairs")), "hopeful")
        edges = stored(self._links(pairs, held), "links")
        if self.mixed:  # the nodes of one id
            each = self.rows.join(self.sets, SAME).select("id", "node").distinct()
            edges = edges.union(each.groupBy("id").agg(F.min("node").alias("m")).join(each, "id").where("node <> m").select(F.col("node").alias("a"), F.col("m").alias("b")))
        roots = components(edges)
        rooted = stored(self._rooted(members, centres, roots), "rooted")
        left = self._left(self._open(rooted, _SKETCHES))
        more = stored(self._met(self._open(stored(rooted.join(left, ["bucket", "node"], "left_semi"), "left"), _BLOCK), held), "links")
        if more.isEmpty():
            return roots
        return components(more.union(roots.selectExpr("root a", "node b")))


def summed(source: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    """``id, text`` with what the text's set is known by."""
    for batch in batches(source, "text"):
        sets = shingle_sets(Words(batch.column("text"), lower=True), shingle)
        n = pa.array([len(s) for s in sets], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("text"), n, *set_sums(sets)], ["id", "text", *SAME])
