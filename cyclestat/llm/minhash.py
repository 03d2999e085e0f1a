"""Near-duplicate documents by one-permutation MinHash.

Signature.  A document is the set of its distinct runs of ``shingle`` words (A-Z
lowered; with fewer words the whole sequence is one).  One hash of each shingle is
dealt to one of ``rows * bands`` bins; a bin keeps its least hash.  An empty bin takes
the value of a bin that the hash of (its number, attempt) names, the first attempt to
hit a filled bin (optimal densification), so two sets agree in each bin with a
probability near their similarity whatever their size.  ``rows`` bins in a row make a
band; documents that agree in a band meet in a bucket.  ``bands`` bands of ``rows`` bins
miss a pair of similarity ``s`` with probability ``(1 - s ** rows) ** bands``: 1e-5 at 0.8
with 48 bands of 7, 3e-6 at 0.85 with 48 bands of 9.

Candidates.  Buckets are compared as ``linking`` says: stars of the least member first, then
blocks for what the stars leave open; every link is confirmed on full sets of 64-bit hashes.

Results.  Documents without words, or null, have an empty set and are linked with nothing.  Rows
that repeat an id are one document: its texts' sets are linked through the id.  Rows
with a null id are left out of components (null).  A component is known by its least id, so ties
make no difference.  A text of any length is whole.  An empty table gives no rows.  Only the two
named columns are read, so names of others cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cyclestat.llm.common import in_task, stored
from cyclestat.llm.linking import SAME, SIGNED, Linker, bitmaps, set_sums
from cyclestat.llm.textbytes import Words, batches, mix, shingle_sets

_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_ATTEMPTS = 4096


def densified(sets: list[np.ndarray], bins: int) -> np.ndarray:
    """One-permutation signatures of non-empty sets, no bin empty."""
    sig = np.full((len(sets), bins), _EMPTY, np.uint64)
    for i, s in enumerate(sets):
        falling = s[::-1]  # sorted sets: the least hash of a bin is written last
        sig[i, (falling & np.uint64(0xFFFFFFFF)) % np.uint64(bins)] = falling
    filled = sig != _EMPTY
    row, col = np.nonzero(~filled & filled.any(axis=1)[:, None])
    donor = np.empty(len(row), np.int64)
    todo = np.arange(len(row))
    for attempt in range(_ATTEMPTS):
        if not len(todo):
            break
        at = (mix(col[todo].astype(np.uint64) * np.uint64(_ATTEMPTS) + np.uint64(attempt + 1)) % np.uint64(bins)).astype(np.int64)
        hit = filled[row[todo], at]
        donor[todo[hit]] = at[hit]
        todo = todo[~hit]
    for k in todo:  # practically never: the next filled bin
        later = np.flatnonzero(filled[row[k]])
        donor[k] = later[np.searchsorted(later, col[k]) % len(later)]
    sig[row, col] = sig[row, donor]
    return sig


def band_keys(sig: np.ndarray, rows: int, bands: int) -> np.ndarray:
    total = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(sig), bands)).copy()
    for k in range(rows):
        total = total * np.uint64(0xD1342543DE82EF95) + sig[:, k::rows][:, :bands]
    return mix(total).view(np.int64)


def signatures(source: Iterator[pa.RecordBatch], shingle: int, rows: int, bands: int) -> Iterator[pa.RecordBatch]:
    """``id, text`` to ``id, n_shingles, set_a, set_b, bits, keys``; equal ``n, a, b``: equal sets."""
    for batch in batches(source, "text"):
        sets = shingle_sets(Words(batch.column("text"), lower=True), shingle)
        n = np.array([len(s) for s in sets], np.int64)
        keys = band_keys(densified(sets, rows * bands), rows, bands)
        full = np.flatnonzero(n)
        lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(np.where(n > 0, bands, 0))]).astype(np.int32), keys[full].ravel())
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n), *set_sums(sets), bitmaps(sets), lists], ["id", *SAME, "bits", "keys"])


class NearDuplicates:
    """Near-duplicate classes of ``docs``; see the module's text."""

    def __init__(self, shingle: int = 5, percent: int = 80, rows: int = 7, bands: int = 48) -> None:
        self.shingle, self.percent, self.rows, self.bands = shingle, percent, rows, bands

    def _signed(self, texts: DataFrame) -> DataFrame:
        kind = texts.schema["id"].dataType.simpleString()
        out = f"id {kind}, {SIGNED}, keys array<long>"
        return stored(texts.mapInArrow(in_task("minhash", "signatures", self.shingle, self.rows, self.bands), out), "near-signed")

    def find(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Per row of ``docs``: ``id_col, n_shingles, component_id``."""
        texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        linker = Linker(self._signed(texts), texts, self.shingle, self.percent)
        members = linker.members(linker.firsts().select(F.explode("keys").alias("bucket"), "set_a"))
        return linker.classes(members).withColumnRenamed("id", id_col)
