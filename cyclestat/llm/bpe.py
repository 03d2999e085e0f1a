"""Byte-level BPE encoding and decoding, with long texts encoded in parts joined as a tree.

Leaves.  A text falls into chunks (white space, or one optional blank and what is not
white space) that the vocabulary's split never crosses.  A chunk is encoded by the
tokenizers library once per Python worker and kept, as bytes, in a cache of bounded size.

Columns.  :meth:`Codec.encode_column` takes a whole Arrow column: texts are cut at blanks and equal
cuts found by Arrow, so that Python sees each distinct one of a batch once; ids are gathered from one
array.  A text in which blanks stand beside other white space, or with a special token, goes the other way.
Words of ASCII and Latin letters, digits and signs are new ones mostly: where the vocabulary has the usual
split, they are cut by it here, by arrays of bytes, and the library's model alone encodes the cuts.

Tree.  Texts of more than ``piece`` characters are halved again and again.  The halves
are rows that Spark deals out and tasks encode in parallel; then the rows of a text are
joined pairwise.  A cut is put at a change of character class near the middle where the
split cannot cross; there, joining is concatenation.  In text that has no such place (a
long run of letters, digits, marks or white space) the cut is inside one run.  Its two
ends are joined by encoding a window of tokens around the join anew, and a larger one
until the window's outer tokens equal those of both sides.  A sequence of tokens is the
encoding of a run exactly if each two neighbours are the encoding of their text; so when
the outer tokens agree the join is exact, whatever the rest.  A chunk that is one long
run is halved and joined in the same way within its task.

A null text is an empty one: no ids.  Rows that repeat are encoded each.  The vocabulary
file is a parameter; every machine needs it at that path.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain, filterfalse, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cyclestat.llm.common import in_task
from cyclestat.llm.textbytes import batches

#: Unicode white space (fixed values).
_WS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_CHUNK = re.compile(f" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
#: The split of the byte-level vocabularies (fixed pattern).
_SPLIT = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
#: Words that :meth:`Codec._plain_ids` cuts as the split does: no apostrophe, single line ends between words.
_PLAIN = "[!-&(-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+"
_PLAIN = rf"\A{_PLAIN}(\n{_PLAIN})*\z"
#: Of each byte of such words: blank, letter (or a part of one), digit, sign, line end.
_KINDS = np.full(256, 3, np.uint8)
_KINDS[[*range(65, 91), *range(97, 123), *range(0x80, 0xCA)]] = 1
_KINDS[48:58], _KINDS[10], _KINDS[32] = 2, 4, 0
_SPACE = re.compile(f"[{_WS}]")
_SPACES = "".join(_SPACE.findall("".join(map(chr, range(0x3001)))))

PIECE = 32768
_RUN = 2048
_NEAR = 512
_CACHED, _CACHED_CHARS = 1_500_000, 64
_TOGETHER = 1_000
_DECODED = 1 << 17


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level vocabularies, by their rule."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def release() -> None:
    """Let go the codecs and their caches."""
    Codec._open.clear()


def _bare(file: dict):
    """A vocabulary file's model alone, without its cache, for text in the byte alphabet that is cut at
    blanks; None if the file's split is not the byte-level one.  The cache serves words that come again;
    :class:`Codec` gives it each once."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    model, split = dict(file["model"]), file.get("pre_tokenizer") or {}
    usual = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not file.get("normalizer")
    if not usual or model.pop("type", None) != "BPE" or model.get("dropout"):
        return None
    model["merges"] = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    bare = Tokenizer(models.BPE(cache_capacity=0, **{k: v for k, v in model.items() if v is not None}))
    bare.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
    return bare


class _Growing:
    """An array to which is added at the end."""

    def __init__(self, dtype: type) -> None:
        self._held, self._n = np.zeros(1024, dtype), 0

    def __len__(self) -> int:
        return self._n

    def add(self, values: np.ndarray) -> None:
        n = self._n + len(values)
        if n > len(self._held):
            self._held = np.concatenate([self._held[: self._n], np.zeros(max(n, n // 2 * 3) - self._n, self._held.dtype)])
        self._held[self._n : n] = values
        self._n = n

    def keep(self, n: int) -> None:
        self._n = n

    def all(self) -> np.ndarray:
        return self._held[: self._n]


class Codec:
    """Encoder and decoder of one vocabulary file."""

    _open: dict[str, Codec] = {}

    @classmethod
    def of(cls, path: str, cached: int = _CACHED) -> Codec:
        """The worker's codec of a file, which keeps about ``cached`` chunks."""
        if path not in cls._open:
            cls._open[path] = cls(path)
        cls._open[path].cached = cached
        return cls._open[path]

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        added = file["added_tokens"]
        self.special = {t["content"]: np.uint32(t["id"]).tobytes() for t in added}
        self._specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if added else None
        alphabet = _byte_alphabet()
        self._codes = np.array([ord(c) for c in sorted(alphabet, key=alphabet.get)], "<u4")
        self._bare = _bare(file)
        vocab = self.library.get_vocab()
        self.token = [b""] * (max(vocab.values()) + 1)
        for text, i in vocab.items():
            self.token[i] = text.encode() if text in self.special else bytes(alphabet[c] for c in text)
        self._length = np.array([len(t) for t in self.token])
        self._start = np.concatenate([[0], np.cumsum(self._length)])
        self._bytes = np.frombuffer(b"".join(self.token), np.uint8)
        self._cache: dict[str, bytes] = {}
        self._words: dict[str, int] = {}
        self._flat, self._ends = _Growing(np.uint32), _Growing(np.int64)
        self.cached = _CACHED

    @staticmethod
    def largest_id(path: str) -> int:
        """The largest id of a vocabulary file."""
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        return max([*file["model"]["vocab"].values(), *(t["id"] for t in file["added_tokens"])])

    # -- encoding -----------------------------------------------------------------

    def parts(self, text: str) -> list[str]:
        """``text`` at its special tokens: plain and special parts in turn."""
        if self._specials is None or not any(s in text for s in self.special):
            return [text]
        return self._specials.split(text)

    def _learn(self, texts: list[list[str]]) -> list[str]:
        """Put the texts' chunks in the cache; returns those too long to stay there."""
        known = self._cache
        if not known or len(known) > self.cached:
            known.clear()
            known.update(self.special)
        missing = list(set(filterfalse(known.__contains__, chain.from_iterable(texts))))
        # A blank and what is not white space is cut from its like by the split also when
        # they stand together, and the library takes one long text faster.  White space
        # alone is not: neighbours would be one run.
        together = [c for c in missing if c[0] == " " and 1 < len(c) <= _RUN and not c.isspace()]
        for i in range(0, len(together), _TOGETHER):
            self._learn_together(together[i : i + _TOGETHER])
        apart = [c for c in missing if len(c) <= _RUN and c not in known]
        for chunk, e in zip(apart, self.library.encode_batch_fast(apart, add_special_tokens=False)):
            known[chunk] = np.array(e.ids, "<u4").tobytes()
        for chunk in missing:
            if len(chunk) > _RUN:
                known[chunk] = b"".join(self._run(t).tobytes() for t in _SPLIT.findall(chunk))
        return [c for c in missing if len(c) > _CACHED_CHARS]

    def _learn_together(self, chunks: list[str]) -> None:
        ids = np.array(self.library.encode_batch_fast(["".join(chunks)], add_special_tokens=False)[0].ids, "<u4")
        ends = np.searchsorted(np.cumsum(self._length[ids]), np.cumsum([len(c.encode()) for c in chunks])) + 1
        raw, at = ids.tobytes(), 0
        for chunk, end in zip(chunks, ends.tolist()):
            self._cache[chunk] = raw[4 * at : 4 * end]
            at = end

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        chunked = []
        for text in texts:
            parts = self.parts(text)
            if len(parts) == 1:
                chunked.append(_CHUNK.findall(text))
            else:
                chunked.append([c for p in parts for c in ([p] if p in self.special else _CHUNK.findall(p))])
        long = self._learn(chunked)
        get = self._cache.__getitem__
        out = [b"".join(map(get, c)) for c in chunked]
        for chunk in long:
            del self._cache[chunk]
        return out

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each has; null is an empty text.

        What follows a blank, up to the next one, is a word here.  The split never crosses from a word's
        blank to what is before it, unless white space stands there or the word is empty or begins with some.
        """
        if len(column) == 0:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if len(self._words) + len(self._cache) > self.cached:
            self._words.clear()
            self._cache.clear()
            self._flat.keep(0)
            self._ends.keep(0)
        column = pc.fill_null(column, "")
        apart = np.zeros(len(column), bool)
        for special in self.special:
            apart |= pc.match_substring(column, special).to_numpy(zero_copy_only=False)
        cut = pc.split_pattern(pc.if_else(pa.array(apart), "", column), " ")
        heads = cut.offsets.to_numpy()[:-1].astype(np.int64)
        row = np.repeat(np.arange(len(column)), np.diff(cut.offsets.to_numpy()))
        coded = cut.values.dictionary_encode()
        place, word = coded.indices.to_numpy(), coded.dictionary
        unit = np.fromiter(map(self._words.get, word.to_numpy(zero_copy_only=False).tolist(), repeat(-1)), np.int64, len(word))
        new = np.flatnonzero(unit < 0)
        missing = word.take(pa.array(new))
        size = pc.binary_length(missing).to_numpy(zero_copy_only=False)
        edged = pc.binary_length(pc.utf8_trim(missing, characters=_SPACES)).to_numpy(zero_copy_only=False) < size
        # Words by which a row cannot be cut: with white space at an end, or empty (but before the first blank).
        barred, empty = np.zeros((2, len(word)), bool)
        barred[new], empty[new] = edged, size == 0
        stops = barred[place] | empty[place]
        stops[heads] = barred[place[heads]]
        apart[row[stops]] = True
        good = np.flatnonzero(~edged & (size > 0))
        long = pc.utf8_length(missing).to_numpy(zero_copy_only=False)[good] > _CACHED_CHARS
        kept, rest = good[~long], good[long]
        unit[new[kept]] = self._add_words(missing.take(pa.array(kept)))
        self._words.update(zip(missing.take(pa.array(kept)).to_numpy(zero_copy_only=False).tolist(), unit[new[kept]].tolist()))
        stay = len(self._flat), len(self._ends)
        unit[new[rest]] = self._add(self.encode([" " + t for t in missing.take(pa.array(rest)).to_pylist()]))
        texts = word.take(pa.array(place[heads])).to_pylist()
        for i in np.flatnonzero(apart).tolist():
            texts[i] = column[i].as_py()
        units = unit[place]
        units[heads] = self._add(self.encode(texts))
        one = np.ones(len(units), bool)
        one[heads] = False
        whole = ~(one & apart[row])  # of a text that is encoded whole, its first unit alone
        units, row = units[whole], row[whole]
        ends, flat = self._ends.all(), self._flat.all()
        starts = np.where(units > 0, ends[units - 1], 0)
        length = ends[units] - starts
        upto = np.cumsum(length)
        ids = flat[np.repeat(starts - upto + length, length) + np.arange(upto[-1])]
        self._flat.keep(stay[0])
        self._ends.keep(stay[1])
        return ids, np.bincount(row, length, len(column)).astype(np.int64)

    def _add_words(self, words: pa.Array) -> np.ndarray:
        """Encode words, each after a blank and many as one text; returns their units."""
        plain = np.zeros(len(words), bool)
        if self._bare:
            plain = pc.match_substring_regex(words, _PLAIN).to_numpy(zero_copy_only=False)
        units = np.zeros(len(words), np.int64)
        for some, encode in ((np.flatnonzero(plain), self._plain_ids), (np.flatnonzero(~plain), self._ids)):
            of = words.take(pa.array(some))
            sizes = pc.binary_length(of).to_numpy(zero_copy_only=False).astype(np.int64) + 1
            texts = of.to_numpy(zero_copy_only=False).tolist()
            units[some] = len(self._ends) + np.arange(len(some))
            for i in range(0, len(texts), _TOGETHER):
                ids = encode(" " + " ".join(texts[i : i + _TOGETHER]))
                ends = np.searchsorted(np.cumsum(self._length[ids]), np.cumsum(sizes[i : i + _TOGETHER])) + 1
                self._ends.add(ends + len(self._flat))
                self._flat.add(ids)
        return units

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _plain_ids(self, text: str) -> np.ndarray:
        """Ids of plain words, each after a blank: cut before a blank and where the kind changes, but not after a blank."""
        data = np.frombuffer(text.encode(), np.uint8)
        kinds = _KINDS[data]
        cuts = np.flatnonzero((kinds[1:] != kinds[:-1]) & (kinds[:-1] > 0)) + 1
        cut = np.insert(self._codes[data], cuts, 32).tobytes().decode("utf-32-le")
        return np.array(self._bare.encode_batch_fast([cut], add_special_tokens=False)[0].ids, np.uint32)

    def _add(self, ids: list[bytes]) -> np.ndarray:
        first = len(self._ends)
        self._ends.add(np.cumsum([len(x) // 4 for x in ids], dtype=np.int64) + len(self._flat))
        self._flat.add(np.frombuffer(b"".join(ids), "<u4"))
        return np.arange(first, len(self._ends))

    def _library(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)

    def _run(self, text: str) -> np.ndarray:
        """Ids of text that the split takes as one, by halves."""
        if len(text) <= _RUN:
            return self._library(text)
        half = len(text) // 2
        return self.join_runs(self._run(text[:half]), self._run(text[half:]))

    def join_runs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ids of one run from the ids of its beginning and its end."""
        k = 4
        while True:
            i, j = max(0, len(a) - k), min(len(b), k)
            while i > 0 and self.token[a[i]][0] & 0xC0 == 0x80:
                i -= 1  # a window begins and ends between characters
            while j < len(b) and self.token[b[j]][0] & 0xC0 == 0x80:
                j += 1
            window = self._library(b"".join(self.token[t] for t in [*a[i:], *b[:j]]).decode())
            left = i == 0 or (len(window) > 1 and window[0] == a[i] and window[1] == a[min(i + 1, len(a) - 1)])
            right = j == len(b) or (len(window) > 1 and window[-1] == b[j - 1] and window[-2] == b[max(j - 2, 0)])
            if left and right:
                return np.concatenate([a[:i], window, b[j:]])
            k *= 2

    # -- pieces -------------------------------------------------------------------

    def cuts(self, text: str, piece: int) -> list[tuple[int, bool]]:
        """Ends of the pieces of ``text``, and whether the cut there is inside a run."""
        marks = list(self._specials.finditer(text)) if self._specials else []
        barred = {p for m in marks for p in range(m.start() + 1, m.end())}
        free = {p for m in marks for p in m.span()}
        out = []

        def halve(lo: int, hi: int) -> None:
            cut = _middle(text, lo, hi, barred, free) if hi - lo > max(piece, 8) else None
            if cut:
                halve(lo, cut[0])
                out.append(cut)
                halve(cut[0], hi)

        halve(0, len(text))
        return [*out, (len(text), False)]

    def leaf(self, text: str, ends: bool) -> tuple[bytes, int, int]:
        """Ids of a piece, and how many belong to its first and last split (if asked)."""
        if not ends:
            return self.encode([text])[0], 0, 0
        split = [s for p in self.parts(text) for s in ([p] if p in self.special else _SPLIT.findall(p))]
        ids = [self.special[s] if s in self.special else self._run(s).tobytes() for s in split]
        return b"".join(ids), len(ids[0]) // 4, len(ids[-1]) // 4

    def join(self, a: tuple, b: tuple, inside: bool) -> tuple:
        """Two neighbouring pieces ``(ids, first, last)`` as one."""
        (x, x_first, x_last), (y, y_first, y_last) = a, b
        if not inside:
            return np.concatenate([x, y]), x_first, y_last
        mid = self.join_runs(x[len(x) - x_last :], y[:y_first])
        first = len(mid) if x_first == len(x) else x_first
        last = len(mid) if y_first == len(y) else y_last
        return np.concatenate([x[: len(x) - x_last], mid, y[y_first:]]), first, last

    # -- decoding -----------------------------------------------------------------

    def decode(self, ids: bytes) -> str:
        every, out = np.frombuffer(ids, "<u4"), []
        for i in range(0, len(every), _DECODED):
            part = every[i : i + _DECODED]
            length = self._length[part]
            end = np.cumsum(length)
            at = np.repeat(self._start[part] - end + length, length) + np.arange(end[-1])
            out.append(self._bytes[at].tobytes())
        return b"".join(out).decode("utf-8", "replace")


def _kind(c: str) -> str:
    if _SPACE.match(c):
        return "space"
    return unicodedata.category(c)[0] if unicodedata.category(c)[0] in "LN" else "other"


def _middle(text: str, lo: int, hi: int, barred: set[int], free: set[int]) -> tuple[int, bool] | None:
    """The cut nearest to the middle that the split cannot cross, else one inside a run.

    ``free`` (beside special tokens) and ``barred`` (within one) places are known.  A window
    of a few hundred characters holds one kind of cut or the other.
    """
    mid, reach = (lo + hi) // 2, min(_NEAR, (hi - lo) // 2 - 3)
    near = [p for d in range(reach) for p in (mid - d, mid + d) if p not in barred]
    kinds = {p: _kind(text[p]) for p in range(mid - reach - 2, mid + reach + 2)}
    for p in near:
        before, after = kinds[p - 1], kinds[p]
        if p in free or before != after and before != "space" and not (text[p - 1] == "'" and after == "L"):
            return p, False
    for p in near:
        if kinds[p - 2] == kinds[p - 1] == kinds[p] == kinds[p + 1]:
            return p, True
    return None


# -- tasks ------------------------------------------------------------------------


def _with_ids(rows: pa.RecordBatch, columns: list[str], ids: list[bytes], codec: Codec) -> pa.RecordBatch:
    kept = [rows.column(c) for c in columns]
    n = pa.array([len(x) // 4 for x in ids], pa.int64())
    texts = pa.array([codec.decode(x) for x in ids], pa.string())
    return pa.RecordBatch.from_arrays([*kept, n, pa.array(ids, pa.binary()), texts], [*columns, "n_tokens", "ids", "decoded"])


def encode_whole(source: Iterator[pa.RecordBatch], path: str, columns: list[str], cached: int) -> Iterator[pa.RecordBatch]:
    codec = Codec.of(path, cached)
    for rows in batches(source, "_text", 2 << 20):
        ids = codec.encode([t or "" for t in rows.column("_text").to_pylist()])
        yield _with_ids(rows, columns, ids, codec)


def split_texts(source: Iterator[pa.RecordBatch], path: str, columns: list[str], piece: int) -> Iterator[pa.RecordBatch]:
    """A row per piece: ``columns, _no, _inside`` (the cut at its end), ``_ends, _text``."""
    codec = Codec.of(path)
    for rows in batches(source, "_text", 1):
        text = rows.column("_text")[0].as_py()
        cuts = codec.cuts(text, piece)
        starts, inside = [0, *[c for c, _ in cuts[:-1]]], [x for _, x in cuts]
        ends = [a or b for a, b in zip(inside, [False, *inside[:-1]])]
        parts = [text[a:b] for a, (b, _) in zip(starts, cuts)]
        kept = [pa.array([rows.column(c)[0].as_py()] * len(cuts), rows.schema.field(c).type) for c in columns]
        made = [pa.array(range(len(cuts)), pa.int32()), pa.array(inside), pa.array(ends), pa.array(parts, pa.string())]
        yield pa.RecordBatch.from_arrays([*kept, *made], [*columns, "_no", "_inside", "_ends", "_text"])


def encode_pieces(source: Iterator[pa.RecordBatch], path: str, columns: list[str], cached: int) -> Iterator[pa.RecordBatch]:
    codec = Codec.of(path, cached)
    for rows in batches(source, "_text", 1 << 20):
        made = [codec.leaf(t, e) for t, e in zip(rows.column("_text").to_pylist(), rows.column("_ends").to_pylist())]
        cols = [pa.array([m[0] for m in made], pa.binary()), *(pa.array([m[i] for m in made], pa.int64()) for i in (1, 2))]
        names = [*columns, "_no", "_inside"]
        yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in names), *cols], [*names, "_ids", "_first", "_last"])


def join_pieces(source: Iterator[pa.RecordBatch], path: str, columns: list[str]) -> Iterator[pa.RecordBatch]:
    """Pieces of a text, in order, to one row; joined as they come, equal sizes first."""
    codec = Codec.of(path)
    kept, stack = None, []

    def fold(least: int) -> None:
        """Join the last two while the last has the weight of its neighbour, or all of them."""
        while len(stack) > 1 and (least or stack[-1][1] >= stack[-2][1]):
            right, left = stack.pop(), stack.pop()
            stack.append((codec.join(left[0], right[0], left[2]), left[1] + right[1], right[2]))

    def done() -> pa.RecordBatch:
        fold(1)
        return _with_ids(kept, columns, [stack[0][0][0].tobytes()], codec)

    for rows in source:
        for i in range(rows.num_rows):
            if rows.column("_no")[i].as_py() == 0:
                if kept is not None:
                    yield done()
                kept, stack = rows.slice(i, 1), []
            ids = np.frombuffer(rows.column("_ids")[i].as_buffer(), "<u4")
            stack.append(((ids, rows.column("_first")[i].as_py(), rows.column("_last")[i].as_py()), 1, rows.column("_inside")[i].as_py()))
            fold(0)
    if kept is not None:
        yield done()


def encode_and_decode(docs: DataFrame, keep: list[str], text_col: str = "text", path: str | None = None, piece: int = PIECE, cached: int = _CACHED) -> DataFrame:
    """Per row of ``docs``: the columns ``keep``, ``n_tokens``, ``ids`` (binary, 32-bit little-endian) and ``decoded``.

    ``keep`` must not hold the three names made here.  ``cached``: chunks that a Python worker keeps.
    """
    path = path or default_vocabulary()
    if clash := {"n_tokens", "ids", "decoded"} & set(keep):
        raise ValueError(f"columns {sorted(clash)} are made here; rename them first")
    rows = docs.select(*keep, F.col(text_col).alias("_text"))
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    made = "n_tokens long, ids binary, decoded string"
    is_long = F.coalesce(F.length("_text"), F.lit(0)) > piece
    whole = rows.where(~is_long).mapInArrow(in_task("bpe", "encode_whole", path, keep, cached), f"{kinds}, {made}")
    keyed = rows.where(is_long).withColumn("_row", F.monotonically_increasing_id())
    cols, cut = [*keep, "_row"], f"{kinds}, _row long, _no int, _inside boolean"
    pieces = keyed.mapInArrow(in_task("bpe", "split_texts", path, cols, piece), f"{cut}, _ends boolean, _text string")
    pieces = pieces.repartition("_row", "_no")
    leaves = pieces.mapInArrow(in_task("bpe", "encode_pieces", path, cols, cached), f"{cut}, _ids binary, _first long, _last long")
    ordered = leaves.repartition("_row").sortWithinPartitions("_row", "_no")
    joined = ordered.mapInArrow(in_task("bpe", "join_pieces", path, keep), f"{kinds}, {made}")
    return whole.union(joined)
