"""N-gram Jaccard join by prefixes of token combinations.

A document is the set of its distinct runs of ``shingle`` words, its tokens (A-Z lowered; with
fewer words the whole sequence is one).  Documents link when their sets' similarity is
``percent`` or more; linked documents make components.

Classes.  The tokens of all documents' sets are counted in ``slots`` counters, dealt by hash, so a
counter bounds the number of documents that hold a token from above.  Tokens whose counter is at most
about ``RARE`` are of class 1, about ``COMMON`` of class 2, the others of class 3 (counters are kept in
steps of a quarter of a doubling).  Class 1 is indexed by
single tokens, class 2 by pairs, class 3 by triples: the more sets hold a token, the more tokens
must be shared to meet.  To keep the combinations of a long text few, classes 2 and 3 are split
by hash into groups of about four tokens of a prefix; tokens are combined within a group.

Prefixes.  Every set is in the same order: class, counter, hash.  A linked set of ``n`` tokens lacks at
most ``e = floor(n * (100 - percent) / 100)`` of them in the other.  A prefix that holds ``p`` tokens of
a group of class ``k`` shares no ``k`` of them only if it lacks ``p - k + 1`` there; so a prefix is
extended until ``max(0, p - k + 1)``, summed over its groups, is more than ``e``.  Of two linked sets, the
one whose prefix ends first then shares ``k`` tokens of a group, all within the other's prefix,
and both emit that combination.  Nothing is missed, whatever the counters say: they only order.

Sizes.  The number of groups follows the octave of the size.  A combination carries its octave;
a set also emits those of the octave of its least partner, where that is the one below.

Meeting.  Sets that emit a combination meet in a bucket.  A token counted once is in one set only
and emits nothing; a set so small that only an equal one can link emits nothing, since equal
sets are one node.  Buckets are compared as ``linking`` says: on full sets, exactly.

The counters take ``4 * slots`` bytes in a task and, as a byte each, are sent to every worker: a fixed
size.  On much larger tables they fill up and tell rare tokens apart less; then the classes are
higher and combinations, not counts, keep buckets small.  Raise ``slots`` there.

Results.  Null or blank texts have an empty set and are linked with nothing (component: own id).
A null id has a null component.  Rows that repeat an id are one document, linked through it.
Ties cannot arise: a component is known by its least id.  An empty table gives no rows.  Texts of
any length are whole; one text's set is what a task holds beside its batch.  Columns other than
the two named are not looked at, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cyclestat.llm.common import in_task, stored
from cyclestat.llm.linking import SAME, SIGNED, Linker, bitmaps, partitions, set_sums
from cyclestat.llm.textbytes import Words, batches, mix, shingle_sets

#: Greatest counter of class 1, and of class 2.
RARE, COMMON = 256, 16384
#: Counters in a row of counts.
_RANGE = 1 << 14


def signed_sets(source: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    """``id, text`` to ``id, n_shingles, set_a, set_b, bits``."""
    for batch in batches(source, "text"):
        sets = shingle_sets(Words(batch.column("text"), lower=True), shingle)
        n = pa.array([len(s) for s in sets], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("id"), n, *set_sums(sets), bitmaps(sets)], ["id", *SAME, "bits"])


def counted(source: Iterator[pa.RecordBatch], shingle: int, slots: int) -> Iterator[pa.RecordBatch]:
    """Texts to ``range, counts``: how many tokens of this task's texts fall to each counter."""
    total = np.zeros(slots, np.int64)
    for batch in batches(source, "text"):
        sets = shingle_sets(Words(batch.column("text"), lower=True), shingle)
        if sets:
            total += np.bincount(slot_of(np.concatenate(sets), slots), minlength=slots)
    for i in range(0, slots, _RANGE):
        part = total[i : i + _RANGE]
        if part.any():
            packed = part.astype(np.min_scalar_type(int(part.max()))).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([i // _RANGE], pa.int32()), pa.array([packed], pa.binary())], ["range", "counts"])


def added(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``range, counts``, all of a range in one task: the logarithms of their sums, a byte each."""
    total: dict[int, np.ndarray] = {}
    for batch in source:
        for i, counts in zip(batch.column("range").to_pylist(), batch.column("counts").to_pylist()):
            part = np.frombuffer(counts, f"<u{len(counts) // _RANGE}").astype(np.int64)
            total[i] = total[i] + part if i in total else part
    for i, part in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([levels(part).tobytes()], pa.binary())], ["range", "counts"])


def levels(counts: np.ndarray) -> np.ndarray:
    """Counts as bytes, four steps a doubling: 0 for none, 1 for one, more for more."""
    return np.where(counts > 0, 1 + np.floor(4 * np.log2(np.maximum(counts, 1))), 0).astype(np.uint8)


def slot_of(tokens: np.ndarray, slots: int) -> np.ndarray:
    return (tokens >> np.uint64(17)).astype(np.int64) & (slots - 1)


def misses(n: np.ndarray | int, percent: int):
    """Tokens of a set of ``n`` that a linked set may lack."""
    return n * (100 - percent) // 100


def octave(n: np.ndarray) -> np.ndarray:
    return np.frexp(np.maximum(n, 1).astype(np.float64))[1] - 1


def signature_keys(sets: list[np.ndarray], table: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``sets`` and the combinations they emit; ``table``: the counters' levels."""
    size = np.array([len(s) for s in sets], np.int64)
    least = -(-size * percent // 100)  # the smallest set that may link
    # Only sets with a partner of another size or content: one more token, or one other.
    active = np.flatnonzero((size > 0) & ((misses(size, percent) > 0) | (size * 100 // percent > size)))
    rows, keys = [], []
    own = octave(size)
    below = octave(least)
    for use in (own, below):
        some = active if use is own else active[below[active] < own[active]]
        if len(some):
            r, k = _combined([sets[i] for i in some], size[some], use[some], table, percent)
            rows.append(some[r])
            keys.append(k)
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(keys)


def _combined(sets: list[np.ndarray], size: np.ndarray, at: np.ndarray, table: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    row = np.repeat(np.arange(len(sets)), size)
    token = np.concatenate(sets)
    level = table[slot_of(token, len(table))]
    rare, common = levels(np.array([RARE, COMMON]))
    kind = 1 + (level > rare).astype(np.int64) + (level > common)
    groups = 1 + 2 * misses(1 << at, percent) // 3
    group = np.where(kind == 1, 0, (mix(token) >> np.uint64(20)).astype(np.int64) % groups[row])
    order = np.lexsort((token, level, row))  # a class is a range of levels
    row, token, level, kind, group = row[order], token[order], level[order], kind[order], group[order]
    # The how-manieth of its group each token is, and what it adds.
    by = np.lexsort((np.arange(len(row)), group, kind, row))
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[by][1:] != row[by][:-1]) | (kind[by][1:] != kind[by][:-1]) | (group[by][1:] != group[by][:-1])
    start = np.flatnonzero(fresh)
    nth = np.empty(len(row), np.int64)
    nth[by] = np.arange(len(row)) - np.repeat(start, np.diff(np.append(start, len(row))))
    adds = (nth >= kind - 1).astype(np.int64)
    before = np.cumsum(adds) - adds
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    inside = before - before[first][row] <= misses(size, percent)[row]
    ends = np.bincount(row, adds * inside, minlength=len(sets))
    if (ends <= misses(size, percent)).any():
        raise ValueError("a set has too few combinations; similarities below 80 % are not served")
    salt = mix(at.astype(np.uint64) + np.uint64(0xA0761D6478BD642F))
    rows, keys = [], []
    single = inside & (kind == 1) & (level > 1)  # level 1: counted once, so in no other set
    rows.append(row[single])
    keys.append(mix(token[single] ^ salt[row[single]]))
    # Groups of classes 2 and 3 as runs of one array.
    by = by[inside[by] & (kind[by] > 1)]
    if len(by):
        fresh = np.ones(len(by), bool)
        fresh[1:] = (row[by][1:] != row[by][:-1]) | (kind[by][1:] != kind[by][:-1]) | (group[by][1:] != group[by][:-1])
        start = np.flatnonzero(fresh)
        held = np.diff(np.append(start, len(by)))
        k_of = kind[by][start]
        for k in (2, 3):
            for p in np.unique(held[(k_of == k) & (held >= k)]):
                runs = start[(k_of == k) & (held == p)]
                for some in np.array_split(runs, 1 + len(runs) * int(p) ** k // 4_000_000):
                    chosen = np.array(list(combinations(range(p), k)))
                    where = by[some[:, None, None] + chosen[None]]  # run, combination, token
                    tokens = np.sort(token[where], axis=2)
                    total = np.broadcast_to(salt[row[where[:, :, 0]]] + np.uint64(k), tokens.shape[:2]).copy()
                    for j in range(k):
                        total = total * np.uint64(0xD1342543DE82EF95) + tokens[:, :, j]
                    rows.append(row[where[:, :, 0]].ravel())
                    keys.append(mix(total).ravel())
    return np.concatenate(rows), np.concatenate(keys).view(np.int64)


def indexed(source: Iterator[pa.RecordBatch], shingle: int, percent: int, packed) -> Iterator[pa.RecordBatch]:
    """``text`` to ``bucket, set_a``, a row per combination."""
    table = np.frombuffer(packed.value, np.uint8)
    for batch in batches(source, "text", 2 << 20):
        sets = shingle_sets(Words(batch.column("text"), lower=True), shingle)
        row, key = signature_keys(sets, table, percent)
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), set_sums(sets)[0].take(pa.array(row))], ["bucket", "set_a"])


class JaccardJoin:
    """Components of ``docs`` linked by the similarity of their sets; see the module's text."""

    def __init__(self, shingle: int = 5, percent: int = 80, slots: int = 1 << 21) -> None:
        if not 80 <= percent <= 100:
            raise ValueError("similarities from 80 % to 100 %")
        if slots < _RANGE or slots & (slots - 1):
            raise ValueError(f"slots: a power of two, {_RANGE} at least")
        self.shingle, self.percent, self.slots = shingle, percent, slots

    def _table(self, texts: DataFrame) -> bytes:
        """The counters' levels over all ``texts``: ``slots`` bytes, whatever the input."""
        rows = texts.select("text").mapInArrow(in_task("ngram_join", "counted", self.shingle, self.slots), "range int, counts binary")
        n = min(partitions(texts), self.slots // _RANGE)
        sums = stored(rows.repartition(n, "range").mapInArrow(in_task("ngram_join", "added"), "range int, counts binary"), "join-counts")
        table = np.zeros(self.slots, np.uint8)
        for row in sums.collect():
            table[row["range"] * _RANGE : (row["range"] + 1) * _RANGE] = np.frombuffer(row["counts"], np.uint8)
        return table.tobytes()

    def find(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Per row of ``docs``: ``id_col, n_shingles, component_id``."""
        spark = docs.sparkSession
        texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        kind = texts.schema["id"].dataType.simpleString()
        signed = stored(texts.mapInArrow(in_task("ngram_join", "signed_sets", self.shingle), f"id {kind}, {SIGNED}"), "join-signed")
        linker = Linker(signed, texts, self.shingle, self.percent)
        packed = spark.sparkContext.broadcast(self._table(texts))
        rows = texts.where("id IS NOT NULL").select("text").mapInArrow(in_task("ngram_join", "indexed", self.shingle, self.percent, packed), "bucket long, set_a long")
        members = linker.members(stored(rows, "join-index"))
        return linker.classes(members).withColumnRenamed("id", id_col)
