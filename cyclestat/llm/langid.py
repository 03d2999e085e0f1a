"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary.  The
probability of a word is the sum, over all its segmentations into pieces, of the product
of the pieces' probabilities, found by a forward pass over its characters.  A text scores
the sum of its words' log probabilities and of the language's log share; the language
with the highest score is predicted, with its posterior as confidence.

Piece probabilities are fitted by expectation maximisation (forward and backward) on
counted words of a sample of labelled rows: all of them up to ``sample_rows``, beyond that
``sample_rows`` on average, languages with less than an equal part of them whole and the same
share, chosen by a hash, of the others.  What returns to the driver, and is broadcast, is one
number per piece and language: 0.3 MB a language.

Words are runs of letters in lower case.  Equal words are scored once per task's batch
and kept by the Python worker in a cache of a bounded number of bytes.  A character that the vocabulary
lacks stands for an unknown piece.

A text that is null or has no letter is ``und`` with score 0, as is every text where no
row is labelled.  A letter is a character of Unicode category L; numbers like fractions are
none.  Ties go to the language that comes first by code point.  Rows are
independent of each other; repeated rows get equal results.  Texts are scored whole, whatever
their length.  An empty table gives no rows; a model of no rows calls all ``und``.  ``lang_pred`` and
``score`` may not be names of columns that are kept; other columns are not looked at.
"""

from __future__ import annotations

import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cyclestat.llm.common import in_task, stored
from cyclestat.llm.textbytes import batches

UNDETERMINED = "und"
_LETTERS = regex.compile(r"\p{L}+")
_MARK = "▁"
_HASH = np.uint64(0x9E3779B97F4A7C15)
_CELLS = 1 << 18
_CACHED_BYTES = 48 << 20
_COUNTED = 300_000
_RESCALE = 16


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def read_pieces(path: str) -> list[str]:
    """Lower-case pieces of letters, with the mark of a word's beginning where they have it."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = (model.id_to_piece(i).lower() for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i)))
    return sorted({t for t in texts if t == _MARK or _LETTERS.fullmatch(t.removeprefix(_MARK))})


class Lattice:
    """The vocabulary's pieces, found in batches of words of one length."""

    _open: dict[str, Lattice] = {}

    @classmethod
    def of(cls, path: str) -> Lattice:
        if path not in cls._open:
            cls._open[path] = cls(read_pieces(path))
        return cls._open[path]

    def __init__(self, pieces: list[str]) -> None:
        self.pieces = pieces
        self.unknown, self.none = len(pieces), len(pieces) + 1
        by_length = defaultdict(list)
        for i, piece in enumerate(pieces):
            by_length[len(piece)].append(i)
        self.longest = max(by_length, default=1)
        self.table = {}
        for n, ids in by_length.items():
            keys = self._keys(np.stack([_codes(pieces[i]) for i in ids]), n)[n][:, 0]
            order = np.argsort(keys)
            self.table[n] = keys[order], np.array(ids, np.int32)[order]

    @staticmethod
    def _keys(codes: np.ndarray, longest: int) -> dict[int, np.ndarray]:
        keys, out = np.zeros(codes.shape, np.uint64), {}
        for n in range(1, min(longest, codes.shape[1]) + 1):
            keys = keys[:, : codes.shape[1] - n + 1] * _HASH + codes[:, n - 1 :] + np.uint64(1)
            out[n] = keys
        return out

    def find(self, codes: np.ndarray) -> dict[int, np.ndarray]:
        """By length, the piece that begins at each place of each word (``none`` if there is none)."""
        found = {}
        for n, keys in self._keys(codes, self.longest).items():
            if n not in self.table and n > 1:
                continue
            known, ids = self.table.get(n, (np.zeros(1, np.uint64), np.array([self.unknown], np.int32)))
            at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
            found[n] = np.where(known[at] == keys, ids[at], self.unknown if n == 1 else self.none)
        return found

    def forward(self, found: dict[int, np.ndarray], p: np.ndarray, m: int, n: int, logs: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Log of the summed probability of ``m`` words of ``n`` characters, and the forward values.

        ``p``: pieces by languages.  Values are scaled now and then, so that no length underflows;
        ``logs``, if given, collects what each place's values were divided by.
        """
        alpha = np.zeros((n + 1, m, p.shape[1]))
        alpha[0] = 1.0
        log = np.zeros((m, p.shape[1]))
        for j in range(1, n + 1):
            for length, ids in found.items():
                if length <= j:
                    alpha[j] += alpha[j - length] * p[ids[:, j - length]]
            if j % _RESCALE == 0 and j < n:
                low = max(0, j - self.longest + 1)
                top = alpha[low : j + 1].max(axis=0)
                alpha[low : j + 1] /= top
                log += np.log(top)
            if logs is not None:
                logs[j] = log
                if j % _RESCALE == 0 and j < n:
                    logs[max(0, j - self.longest + 1) : j] = log
        return log + np.log(alpha[n]), alpha

    def expected(self, words: list[str], counts: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Expected uses of each piece over ``words`` (each ``counts`` times) under one language's ``p``.

        Both passes are scaled, so words of any length teach.
        """
        uses = np.zeros(len(p))
        for at, codes in _by_length(words):
            m, n = codes.shape
            found = self.find(codes)
            up = np.zeros((n + 1, m, 1))
            total, alpha = self.forward(found, p[:, None], m, n, up)
            beta, down, log = np.zeros((n + 1, m)), np.zeros((n + 1, m)), np.zeros(m)
            beta[n] = 1.0
            for j in range(n - 1, -1, -1):
                for length, ids in found.items():
                    if j + length <= n:
                        beta[j] += p[ids[:, j]] * beta[j + length]
                if (n - j) % _RESCALE == 0 and j > 0:
                    high = min(n, j + self.longest - 1)
                    top = beta[j : high + 1].max(axis=0)
                    beta[j : high + 1] /= top
                    log = log + np.log(top)
                    down[j : high + 1] = log
                down[j] = log
            for length, ids in found.items():
                for j in range(n - length + 1):
                    weight = counts[at] * np.exp(up[j, :, 0] + down[j + length] - total[:, 0])
                    uses += np.bincount(ids[:, j], alpha[j, :, 0] * p[ids[:, j]] * beta[j + length] * weight, len(p))
        uses[self.none] = 0.0
        return uses


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices and character codes (with the mark) of words of one length, in blocks."""
    groups = defaultdict(list)
    for i, word in enumerate(words):
        groups[len(word) + 1].append(i)
    for n, ids in groups.items():
        step = max(1, _CELLS // n)
        for i in range(0, len(ids), step):
            block = ids[i : i + step]
            codes = _codes("".join(_MARK + words[k] for k in block)).reshape(len(block), n)
            yield np.array(block), codes


def release() -> None:
    """Let go the vocabulary's pieces and the words' scores."""
    Lattice._open.clear()
    Scorer._open.clear()


class Scorer:
    """Word scores under a model, with a cache."""

    _open: dict[str, Scorer] = {}

    @classmethod
    def of(cls, model) -> Scorer:
        """``model``: a Spark broadcast of ``name, path, languages, piece probabilities, log shares``."""
        name, *rest = model.value
        if name not in cls._open:
            cls._open.clear()
            cls._open[name] = cls(*rest)
        return cls._open[name]

    def __init__(self, path: str, languages: list[str], p: np.ndarray, shares: np.ndarray) -> None:
        self.lattice, self.languages, self.p, self.shares = Lattice.of(path), languages, p, shares
        self.row: dict[str, int] = {}  # of a word in the table of scores
        #: Words kept: a score per language and the word itself.
        self.most = max(1_000, _CACHED_BYTES // (8 * len(languages) + 160))
        self.table = np.empty((self.most, len(languages)))

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.row]
        if len(self.row) + len(new) > len(self.table):
            self.row.clear()
            new = list(words)
            self.table = np.empty((max(self.most, len(new)), len(self.languages)))
        first = len(self.row)
        for at, codes in _by_length(new):
            self.table[first + at], _ = self.lattice.forward(self.lattice.find(codes), self.p, *codes.shape)
        self.row.update(zip(new, range(first, first + len(new))))

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        words = [_LETTERS.findall(t.lower()) if t else [] for t in texts]
        counts = [Counter(w) for w in words]
        self.learn(set().union(*counts))
        names, scores = [], []
        for own in counts:
            if not own or not self.languages:
                names.append(UNDETERMINED)
                scores.append(0.0)
                continue
            total = self.shares + np.array(list(own.values()), float) @ self.table[[self.row[w] for w in own]]
            best = int(np.argmax(total))
            names.append(self.languages[best])
            scores.append(float(1.0 / np.exp(total - total[best]).sum()))
        return names, scores


# -- tasks ------------------------------------------------------------------------


def count_words(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``lang, text`` to ``lang, word, n``, summed while the table of words is small."""
    tally: Counter = Counter()

    def rows() -> pa.RecordBatch:
        keys = list(tally)
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(list(tally.values()), pa.int64())], ["lang", "word", "n"])

    for batch in batches(source, "text"):
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            for word, n in Counter(_LETTERS.findall((text or "").lower())).items():
                tally[lang, word] += n
        if len(tally) > _COUNTED:
            yield rows()
            tally.clear()
    if tally:
        yield rows()


def piece_uses(source: Iterator[pa.RecordBatch], path: str, model) -> Iterator[pa.RecordBatch]:
    """``lang, word, n`` to expected uses ``lang, piece, uses`` under ``model`` (language to probabilities)."""
    lattice, uses = Lattice.of(path), {}
    for batch in source:
        langs = np.array(batch.column("lang").to_pylist(), object)
        words, n = batch.column("word").to_pylist(), batch.column("n").to_numpy()
        for lang in set(langs):
            at = np.flatnonzero(langs == lang)
            own = lattice.expected([words[i] for i in at], n[at], model.value[lang])
            uses[lang] = uses.get(lang, 0) + own
    for lang, u in uses.items():
        at = np.flatnonzero(u)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(u[at])], ["lang", "piece", "uses"])


def predict_texts(source: Iterator[pa.RecordBatch], model, text_col: str, kept: list[str]) -> Iterator[pa.RecordBatch]:
    scorer = Scorer.of(model)
    for batch in batches(source, text_col, 2 << 20):
        names, scores = scorer.predict(batch.column(text_col).to_pylist())
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*kept, "lang_pred", "score"])


# -- the operator -----------------------------------------------------------------


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = 20_000, rounds: int = 3, smoothing: float = 0.1, path: str | None = None):
    """A broadcast model from rows of ``labelled`` whose language is not null."""
    path = path or default_vocabulary()
    spark = labelled.sparkSession
    rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"), F.xxhash64(id_col).alias("draw")).where("lang IS NOT NULL")
    shares = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per language
    total = sum(shares.values())
    if total > sample_rows:
        each = sample_rows // len(shares)  # rare languages whole, the others by what is left
        rare = sum(n for n in shares.values() if n <= each)
        share = (sample_rows - rare) / max(1, sum(n for n in shares.values() if n > each))
        drawn = F.pmod("draw", F.lit(1 << 30)) < int((1 << 30) * share)
        rows = rows.where(drawn | F.col("lang").isin([lang for lang, n in shares.items() if n <= each]))
    words = rows.drop("draw").mapInArrow(in_task("langid", "count_words"), "lang string, word string, n long")
    words = stored(words.groupBy("lang", "word").agg(F.sum("n").alias("n")), "langid-words")
    size = len(Lattice.of(path).pieces) + 2
    languages = sorted(shares)
    p = {lang: np.full(size, 1.0 / (size - 1)) for lang in languages}
    for lang in languages:
        p[lang][-1] = 0.0
    for _ in range(rounds):
        uses = words.mapInArrow(in_task("langid", "piece_uses", path, spark.sparkContext.broadcast(p)), "lang string, piece int, uses double")
        got = {lang: np.full(size, smoothing) for lang in languages}
        for r in uses.groupBy("lang", "piece").agg(F.sum("uses").alias("uses")).toLocalIterator():  # pieces by languages
            got[r["lang"]][r["piece"]] += r["uses"]
        for lang in languages:
            got[lang][-1] = 0.0
            p[lang] = got[lang] / got[lang].sum()
    probabilities = np.stack([p[lang] for lang in languages], axis=1) if languages else np.zeros((size, 0))
    return spark.sparkContext.broadcast((uuid.uuid4().hex, path, languages, probabilities, np.log([shares[lang] / total for lang in languages])))


def predict(docs: DataFrame, model, keep: list[str], text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: the columns ``keep`` (the text may be one), ``lang_pred`` and ``score``."""
    if clash := {"lang_pred", "score"} & set(keep):
        raise ValueError(f"columns {sorted(clash)} are made here; rename them first")
    rows = docs.select(*dict.fromkeys([*keep, text_col]))
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(in_task("langid", "predict_texts", model, text_col, list(keep)), f"{kinds}, lang_pred string, score double")


def accepted(least: float = 0.5) -> Column:
    """The rows a filter keeps: a language was found, and it is likelier than not."""
    return (F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least)
