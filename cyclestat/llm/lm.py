"""Language-model scores: a log-bilinear neural model trained by noise-contrastive estimation.

Tokens are words (A-Z lowered) and one end per text.  Three things are gathered from all
learning rows: how often each word occurs (by Spark, words as 64-bit hashes), the most
frequent words (at most ``frequent``, by a count threshold), and a neural model over ``vocab``
classes of tokens: the most frequent words, the end, and ``OTHERS`` classes of all other words
by their last two bytes.

The model is log-bilinear: the vectors of the two tokens before (one table per place) add up
to a prediction; its products with the classes' output vectors, plus a bias, are the logits.
It is trained in numpy by noise-contrastive estimation with noise drawn from the classes'
frequencies: first on a bounded sample of rows in one task, for a common start; then every
task goes on from there over all tokens of its learning rows, and the parameters are averaged,
weighted by tokens.  Averages and counts are Spark aggregates; the driver gets the averaged
parameters only, whose size is fixed.

Scoring gives normalised log probabilities: the log of the sum over all classes is found by
batched matrix products, once for each distinct pair of tokens before that a worker meets (it
keeps one number per pair of classes while the model is in use).  A word
outside the model's own words has its class's probability times its share of the class,
``(c + 1/2) / (sum over the class + 1/2)``, the last half for words never seen.

Frequent words are looked up in a broadcast table of bounded size.  The rest of a text's words
are rows, joined by Spark with the counts and summed per text; they are rare, so no key is hot.

A null or empty text is the end alone.  Without learning rows every count is 0 and the classes
are equally likely.  Each row is scored for itself, repeated ids or texts alike; no rows give
none.  Texts are learned from and scored whole, whatever their length; one text's tokens are
what a task holds beside its batch.  Words of equal count go into the model by the order of their
hashes.  Columns that are kept may not bear the names of those made here; others are not looked at.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cyclestat.llm.common import in_task, stored
from cyclestat.llm.textbytes import Words, batches

OTHERS = 32
END = np.int64(-1) - np.int64(OTHERS)  # the end's id; its low bits are no class
_SIZE = 24
_BATCH = 8192
_NOISE = 64
_RATE = 0.15
#: Pairs of tokens before whose sums a model keeps, 8 bytes each.
_PAIRS_KEPT = 1 << 22
_LN10 = float(np.log(10.0))


def token_ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all tokens of a column, and where each row's begin and the last end.

    An id is a hash of the word whose low bits are the class of its last two bytes.
    """
    words = Words(column, lower=True)
    low = np.where((words.data >= 65) & (words.data <= 90), words.data + 32, words.data).astype(np.int64)
    last = low[words.ends - 1]
    before = np.where(words.ends - words.starts > 1, low[words.ends - 2], 0)
    ids = (words.hash.view(np.int64) & np.int64(~(OTHERS - 1))) | ((last * 7 + before * 13) % OTHERS)
    edges = words.first + np.arange(words.rows + 1)
    out = np.full(edges[-1], END, np.int64)
    out[np.arange(len(ids)) + words.row] = ids
    return out, edges


@dataclass
class Table:
    """The frequent words: sorted ids, counts, and each one's class in the model."""

    ids: np.ndarray
    counts: np.ndarray
    classes: np.ndarray
    vocab: int

    @property
    def n_classes(self) -> int:
        return self.vocab + 1 + OTHERS

    def find(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each id in the table (-1: not in it), and its class."""
        if not len(self.ids):
            return np.full(len(ids), -1), self._other(ids)
        at = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
        hit = self.ids[at] == ids
        return np.where(hit, at, -1), np.where(hit, self.classes[at], self._other(ids))

    def _other(self, ids: np.ndarray) -> np.ndarray:
        return np.where(ids == END, self.vocab, self.vocab + 1 + (ids & (OTHERS - 1)))

    @classmethod
    def of(cls, ids: np.ndarray, counts: np.ndarray, vocab: int) -> Table:
        order = np.lexsort((ids, -counts))
        own = order[ids[order] != END][:vocab]
        table = cls(ids, counts, np.zeros(len(ids), np.int64), vocab)
        table.classes = table._other(ids)
        table.classes[own] = np.arange(len(own))
        by_id = np.argsort(ids)
        table.ids, table.counts, table.classes = ids[by_id], counts[by_id], table.classes[by_id]
        return table


class Model:
    """Parameters: vectors of the token before, of the one before that, and outputs with a bias."""

    def __init__(self, one: np.ndarray, two: np.ndarray, out: np.ndarray) -> None:
        self.one, self.two, self.out = one, two, out  # [classes + 1, size], the same, [classes, size + 1]
        self._norms: np.ndarray | None = None

    @classmethod
    def start(cls, shares: np.ndarray, size: int = _SIZE) -> Model:
        draw = np.random.default_rng(7)
        n = len(shares)
        vectors = [draw.normal(0.0, 0.1, (n + 1, size)) for _ in range(2)]
        return cls(*vectors, np.column_stack([draw.normal(0.0, 0.1, (n, size)), np.log(shares)]))

    def rows(self) -> np.ndarray:
        """All parameters as rows of equal width."""
        pad = [np.column_stack([t, np.zeros(len(t))]) for t in (self.one, self.two)]
        return np.concatenate([*pad, self.out])

    @classmethod
    def of_rows(cls, rows: np.ndarray, dtype=np.float64) -> Model:
        n = (len(rows) - 2) // 3
        rows = rows.astype(dtype)
        return cls(rows[: n + 1, :-1].copy(), rows[n + 1 : 2 * n + 2, :-1].copy(), rows[2 * n + 2 :].copy())

    def train(self, target: np.ndarray, before: np.ndarray, before2: np.ndarray, noise: np.ndarray, seed: int, squares: list | None = None) -> list:
        """One pass of noise-contrastive estimation with AdaGrad; ``squares`` carries its state."""
        draw = np.random.default_rng(seed)
        state = squares or [np.full(t.shape, 1e-2, t.dtype) for t in (self.one, self.two, self.out)]
        log_noise = (np.log(noise) + np.log(_NOISE)).astype(self.out.dtype)
        cumulated = np.cumsum(noise)
        for i in range(0, len(target), _BATCH):
            t, a, b = target[i : i + _BATCH], before[i : i + _BATCH], before2[i : i + _BATCH]
            wrong = np.minimum(np.searchsorted(cumulated, draw.random(_NOISE) * cumulated[-1]), len(noise) - 1)
            r = self.one[a] + self.two[b]
            q, qn = self.out[t], self.out[wrong]
            good = (r * q[:, :-1]).sum(axis=1) + q[:, -1] - log_noise[t]
            bad = r @ qn[:, :-1].T + qn[:, -1] - log_noise[wrong]
            g = 1.0 - _sigmoid(good)
            gn = -_sigmoid(bad)
            dr = g[:, None] * q[:, :-1] + gn @ qn[:, :-1]
            scale = 1.0 / len(t)
            self._step(0, state, a, dr * scale)
            self._step(1, state, b, dr * scale)
            d_good = np.column_stack([g[:, None] * r, g]) * scale
            d_bad = np.column_stack([gn.T @ r, gn.sum(axis=0)]) * scale
            self._step(2, state, np.concatenate([t, wrong]), np.concatenate([d_good, d_bad]))
        return state

    def _step(self, which: int, state: list, rows: np.ndarray, grad: np.ndarray) -> None:
        order = np.argsort(rows, kind="stable")
        at, first = np.unique(rows[order], return_index=True)
        total = np.add.reduceat(grad[order], first, axis=0)
        table = (self.one, self.two, self.out)[which]
        total *= 100.0
        state[which][at] += total**2
        table[at] += _RATE * total / np.sqrt(state[which][at])

    def log_probabilities(self, target: np.ndarray, before: np.ndarray, before2: np.ndarray) -> np.ndarray:
        """Natural log of the normalised probability of each target class."""
        pairs = before * np.int64(len(self.one)) + before2
        norm = self._normalised(pairs)
        r = self.one[before] + self.two[before2]
        return (r * self.out[target, :-1]).sum(axis=1) + self.out[target, -1] - norm

    def _normalised(self, pairs: np.ndarray) -> np.ndarray:
        """Log of the sum over all classes after each pair of tokens: each pair's once while the model is kept."""
        n = len(self.one)
        if self._norms is None and n * n <= _PAIRS_KEPT:
            self._norms = np.full(n * n, np.nan)
        if self._norms is None:
            distinct, which = np.unique(pairs, return_inverse=True)
            return self._sums(distinct)[which]
        new = np.zeros(n * n, bool)
        new[pairs] = True
        new = np.flatnonzero(new & np.isnan(self._norms))
        self._norms[new] = self._sums(new)
        return self._norms[pairs]

    def _sums(self, pairs: np.ndarray) -> np.ndarray:
        norm = np.empty(len(pairs))
        step = max(1, (1 << 22) // len(self.out))
        for i in range(0, len(pairs), step):
            a, b = np.divmod(pairs[i : i + step], len(self.one))
            logits = (self.one[a] + self.two[b]) @ self.out[:, :-1].T + self.out[:, -1]
            top = logits.max(axis=1, keepdims=True)
            logits -= top
            np.exp(logits, out=logits)
            norm[i : i + step] = top[:, 0] + np.log(logits.sum(axis=1))
        return norm


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40.0, 40.0)))


def contexts(classes: np.ndarray, edges: np.ndarray, begin: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the tokens one and two before; ``begin`` where the text has none."""
    one = np.concatenate([[begin], classes[:-1]])
    two = np.concatenate([[begin, begin], classes[:-2]])[: len(classes)]
    starts = edges[:-1]  # each row has its end, so no row is empty
    one[starts] = begin
    two[starts] = begin
    second = starts + 1
    two[second[second < edges[1:]]] = begin
    return one, two


class _Kept:
    """The model that this worker scored with last, and its sums so far."""

    rows: np.ndarray | None = None
    own: Model | None = None

    @classmethod
    def model(cls, rows: np.ndarray) -> Model:
        if cls.rows is None or not np.array_equal(cls.rows, rows):
            cls.rows, cls.own = rows, Model.of_rows(rows)
        return cls.own


def release() -> None:
    """Let go the model and its sums."""
    _Kept.rows = _Kept.own = None


# -- tasks ------------------------------------------------------------------------


def count_tokens(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches(source, "text"):
        ids, n = np.unique(token_ids(batch.column("text"))[0], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n, pa.int64())], ["id", "n"])


def train_rows(source: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    """Learning rows ``text`` to parameters ``row, weight, v`` after one pass from the start."""
    table, shares, start = model.value
    own, seen, state = Model.of_rows(start, np.float32), 0, None  # single precision takes half the time
    for batch in batches(source, "text"):
        ids, edges = token_ids(batch.column("text"))
        classes = table.find(ids)[1]
        one, two = contexts(classes, edges, table.n_classes)
        order = np.random.default_rng(len(ids)).permutation(len(ids))
        state = own.train(classes[order], one[order], two[order], shares, len(ids), state)
        seen += len(ids)
    if seen:
        rows = own.rows().astype(np.float64)
        values = pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1], rows.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(rows), dtype=np.int32)), pa.array(np.full(len(rows), float(seen))), values], ["row", "weight", "v"])


def score_rows(source: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    """Rows ``_text`` and others to sums over their frequent tokens, and the ids of the rest."""
    table, rows, shares_of_class = model.value
    own = _Kept.model(rows)
    known_log = np.log10(table.counts + 0.5)
    outside = table.classes > table.vocab
    within = np.where(outside, known_log - np.log10(shares_of_class[np.where(outside, table.classes - table.vocab - 1, 0)]), 0.0)
    for batch in batches(source, "_text", 1 << 20):  # a token takes four vectors while it is scored
        ids, edges = token_ids(batch.column("_text"))
        at, classes = table.find(ids)
        one, two = contexts(classes, edges, table.n_classes)
        hit = at >= 0
        neural = own.log_probabilities(classes, one, two) / _LN10
        base = np.where(hit, known_log[at] if len(known_log) else 0.0, 0.0)
        neural += np.where(hit, within[at] if len(known_log) else 0.0, 0.0)
        sums = [np.add.reduceat(x, edges[:-1]) if len(x) else x for x in (hit.astype(np.int64), base, neural)]
        rest = np.concatenate([[0], np.cumsum(~hit)])[edges].astype(np.int32)
        kept = [c for c in batch.schema.names if c != "_text"]
        made = [pa.array(np.diff(edges), pa.int64()), *(pa.array(x) for x in sums), pa.ListArray.from_arrays(rest, ids[~hit])]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *made], [*kept, "n_tokens", "n_known", "base", "neural", "rest"])


# -- the operator -----------------------------------------------------------------


@dataclass
class Fitted:
    """What was learned: counts (a table in shared storage) and the broadcast model."""

    counts: DataFrame
    threshold: int
    train_tokens: int
    distinct: int
    model: object
    class_sums: np.ndarray


def _averaged(rows: DataFrame, given) -> np.ndarray | None:
    """Parameters after ``train_rows``, averaged over tasks by tokens."""
    width = _SIZE + 1
    made = rows.select("text").mapInArrow(in_task("lm", "train_rows", given), "row int, weight double, v array<double>")
    mean = [(F.sum(F.col("weight") * F.get("v", F.lit(i))) / F.sum("weight")).alias(f"v{i}") for i in range(width)]
    got = made.groupBy("row").agg(*mean).orderBy("row").toPandas()  # as many rows as the model has
    return got[[f"v{i}" for i in range(width)]].to_numpy() if len(got) else None


def fit(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab: int = 1023, frequent: int = 200_000, start_rows: int = 2_000) -> Fitted:
    """Learn from all ``rows``; ``start_rows`` of them, on average and by a hash, give the common start."""
    spark = rows.sparkSession
    texts = rows.select(F.col(text_col).alias("text"), F.pmod(F.xxhash64(id_col), F.lit(1 << 30)).alias("draw"))
    counted = texts.select("text").mapInArrow(in_task("lm", "count_tokens"), "id long, n long")
    counts = stored(counted.groupBy("id").agg(F.sum("n").alias("n")), "lm-counts")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()

    levels = counts.groupBy("n").agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("n")).limit(frequent).collect()
    threshold, held = 1 << 62, 0
    for level in levels:
        held += level["words"]
        if held > frequent:
            break
        threshold = level["n"]
    top = counts.where(F.col("n") >= threshold).toPandas()  # at most ``frequent`` rows
    table = Table.of(top["id"].to_numpy(np.int64), top["n"].to_numpy(np.int64), vocab)

    # Sums per class: all words of it, less those the model knows by themselves.
    other = F.col("id").bitwiseAND(OTHERS - 1)
    sums = counts.where(F.col("id") != int(END)).groupBy(other.alias("k")).agg(F.sum("n").alias("n"), F.sum(F.col("n") + 0.5).alias("s")).collect()
    class_counts, class_sums = np.zeros(OTHERS), np.full(OTHERS, 0.5)
    for r in sums:
        class_counts[r["k"]] += r["n"]
        class_sums[r["k"]] += r["s"]
    own = table.classes < vocab
    np.subtract.at(class_counts, table.ids[own] & (OTHERS - 1), table.counts[own])
    np.subtract.at(class_sums, table.ids[own] & (OTHERS - 1), table.counts[own] + 0.5)
    shares = np.full(table.n_classes, 0.5)
    shares[table.classes[own]] += table.counts[own]
    shares[vocab] += table.counts[table.ids == END].sum()
    shares[vocab + 1 :] += class_counts
    shares /= shares.sum()

    params = Model.start(shares).rows()
    n_rows = rows.count()
    draw = F.col("draw") < int((1 << 30) * min(1.0, start_rows / max(1, n_rows)))
    for part in (texts.where(draw).repartition(1), texts):  # the sample is drawn by all tasks and trained in one
        got = _averaged(part, spark.sparkContext.broadcast((table, shares, params)))
        params = params if got is None else got
    return Fitted(counts, threshold, int(total), int(distinct), spark.sparkContext.broadcast((table, params, class_sums)), class_sums)


def score(docs: DataFrame, fitted: Fitted, keep: list[str], text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: the columns ``keep``, ``n_tokens, n_known, train_tokens, base_score, score``.

    Logs are to base 10.  ``n_known``: tokens seen in learning; ``base_score``: add-half
    unigrams; ``score``: the neural model.
    """
    made = ("n_tokens", "n_known", "train_tokens", "base_score", "score", "base", "neural", "rest", "_row")
    if clash := set(made) & set(keep):
        raise ValueError(f"columns {sorted(clash)} are made here; rename them first")
    rows = docs.select(*keep, F.monotonically_increasing_id().alias("_row"), F.col(text_col).alias("_text"))
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in [*keep, "_row"])
    run = in_task("lm", "score_rows", fitted.model)
    scored = stored(rows.mapInArrow(run, f"{kinds}, n_tokens long, n_known long, base double, neural double, rest array<long>"), "lm-scored")

    rest = scored.select("_row", F.explode("rest").alias("id"))
    rare = fitted.counts.where(F.col("n") < fitted.threshold).withColumnRenamed("id", "word")
    n = F.coalesce(F.col("n"), F.lit(0))
    logs = F.log10(n + F.lit(0.5))
    of_class = F.element_at(F.lit([float(x) for x in np.log10(fitted.class_sums)]), (F.col("id").bitwiseAND(OTHERS - 1) + 1).cast("int"))
    more = rest.join(rare, rest["id"] == rare["word"], "left").select(
        "_row", (n > 0).cast("long").alias("k"), logs.alias("b"), F.when(F.col("id") == int(END), 0.0).otherwise(logs - of_class).alias("s")
    )
    more = more.groupBy("_row").agg(F.sum("k").alias("k"), F.sum("b").alias("b"), F.sum("s").alias("s")).withColumnRenamed("_row", "_r")
    both = scored.drop("rest").join(more, F.col("_row") == F.col("_r"), "left")
    zero = F.lit(0.0)
    below = float(np.log10(fitted.train_tokens + 0.5 * (fitted.distinct + 1)))
    return both.select(
        *keep,
        "n_tokens",
        (F.col("n_known") + F.coalesce("k", F.lit(0))).alias("n_known"),
        F.lit(fitted.train_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("b", zero) - F.col("n_tokens") * F.lit(below)).alias("base_score"),
        (F.col("neural") + F.coalesce("s", zero)).alias("score"),
    )


def learns(id_col: str = "doc_id", folds: int = 5, held_out: int = 1) -> Column:
    """Rows to learn from: all whose deal is not ``held_out``; a null id is dealt as 0."""
    from cyclestat.llm.common import id_remainder

    return F.coalesce(id_remainder(id_col, folds), F.lit(0)) != held_out
