"""Token files: an exact round trip through the files, in ascending order of ids."""

import zlib

import numpy as np
import pyarrow as pa
import pytest

from cyclestat.llm import bpe, tokenfiles
from cyclestat.llm.common import scratch

CODEC = bpe.Codec.of(bpe.default_vocabulary())


def own_ids(text):
    return [*CODEC.library.encode(text or "", add_special_tokens=False).ids, 0]


@pytest.mark.parametrize("dtype", [None, "<u2", "<u4"])
def test_round_trip(spark, dtype):
    rows = [(i * 37 % 101, "w%d é " % i * (i % 9)) for i in range(101)] + [(5, None), (5, ""), (None, "no id"), (7, "x " * 20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    folder = scratch(spark, "tokens")
    tokenfiles.write_corpus(docs, folder, dtype=dtype)
    got = tokenfiles.read_corpus(spark, folder).collect()
    want, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = own_ids(text)
        want.append((doc_id, start, len(ids), np.array(ids, "<u4").tobytes()))
        start += len(ids)
    got = sorted(((r.doc_id, r.start, r.n_tokens, bytes(r.ids)) for r in got), key=lambda r: r[1])
    assert got == want
    digests = {(r.start, r.ids_crc32) for r in tokenfiles.read_corpus(spark, folder, digest=True).collect()}
    assert digests == {(s, zlib.crc32(x)) for _, s, _, x in want}


def test_width_is_checked(spark):
    docs = spark.createDataFrame([(1, "hello world")], "doc_id long, text string")
    with pytest.raises(Exception, match="does not fit"):
        tokenfiles.write_corpus(docs, scratch(spark, "tokens"), dtype="u1")


def test_empty_table(spark):
    folder = scratch(spark, "tokens")
    tokenfiles.write_corpus(spark.createDataFrame([], "doc_id long, text string"), folder)
    assert tokenfiles.read_corpus(spark, folder).collect() == []


def test_unmounted_folder():
    with pytest.raises(ValueError):
        tokenfiles.local_path("hdfs://store/tokens")


class _Counted:
    """The library, counting the characters that it is given."""

    def __init__(self, library):
        self.library, self.characters = library, 0

    def encode_batch_fast(self, texts, **kw):
        self.characters += sum(map(len, texts))
        return self.library.encode_batch_fast(texts, **kw)

    def __getattr__(self, name):
        return getattr(self.library, name)


def test_a_shard_gives_each_word_to_the_library_once_and_cuts_plain_texts_by_arrow(tmp_path, monkeypatch):
    codec = bpe.Codec(bpe.default_vocabulary())
    codec.library = _Counted(codec.library)
    monkeypatch.setitem(bpe.Codec._open, bpe.default_vocabulary(), codec)
    monkeypatch.setattr("pyspark.TaskContext.get", lambda: type("Context", (), {"partitionId": lambda self: 0})())
    whole = []
    encode = codec.encode
    codec.encode = lambda texts: (whole.extend(texts), encode(texts))[1]
    texts = [f"Start of{i} some words, é, with\nlines of{i} 1,234 words" for i in range(50)]
    rows = pa.RecordBatch.from_pydict({"id": list(range(50)), "text": texts})
    (sizes,) = tokenfiles.write_shard(iter([rows, rows]), str(tmp_path), bpe.default_vocabulary(), 0, "<u2")
    assert np.fromfile(tmp_path / "ids-000000.bin", "<u2").tolist() == 2 * [i for t in texts for i in own_ids(t)]
    assert sizes.column("n_docs").to_pylist() == [100]
    words = {w for t in texts for w in t.split(" ")}
    assert codec.library.characters <= sum(len(w) + 1 for w in words) + len("Start")
    assert set(whole) <= {"Start"}


def test_columns_are_encoded_as_the_library_does(monkeypatch):
    monkeypatch.setattr(bpe, "_RUN", 64)
    rng = np.random.default_rng(5)
    marks = [" ", " ", " ", "  ", "\n", "\t", "\x1c", "\x85", "　", "a", "Foo", "bar", "'s", "'", "12", "é", "日本", "😀", "<|endoftext|>", "x" * 70, ".", ",", "\r\n"]
    texts = ["", None, " ", "  ", " a", "a ", "\n a", "a\n b", "z" * 500, "b " + "q" * 500 + " c", "a <|endoftext|> b", *("".join(rng.choice(marks, n)) for n in rng.integers(0, 14, 3000))]
    codec = bpe.Codec(bpe.default_vocabulary())
    for cached in (1_500_000, 3):
        codec.cached = cached
        for part in (texts[:1], texts[:7], texts, texts[::-1], texts[3:2]):
            ids, counts = codec.encode_column(pa.array(part, pa.string()))
            assert [x.tolist() for x in np.split(ids, np.cumsum(counts))[:-1]] == [own_ids(t)[:-1] for t in part]
            sliced, _ = codec.encode_column(pa.array(["skipped", *part], pa.large_string())[1:])
            assert sliced.tolist() == ids.tolist()


def test_plain_words_are_cut_here_and_encoded_by_the_model_alone():
    codec = bpe.Codec(bpe.default_vocabulary())
    codec.library = _Counted(codec.library)
    plain = ["x Novelword, größe 12ab,3! (Ærø)", "x one.\nTwo\n3 Ȁɏ-{~}"]
    ids, _ = codec.encode_column(pa.array(plain))
    assert codec.library.characters <= len("x")
    other = ["x don't 'll", "x a×b ÷ Ω", "x a\n\nb ²3 \xad", "x \x01c \x7f ɐ 日本9"]
    more, _ = codec.encode_column(pa.array([*plain, *other]))
    assert [*ids, *more] == [i for t in [*plain, *plain, *other] for i in own_ids(t)[:-1]]


def test_plain_words_as_the_library_does():
    rng = np.random.default_rng(6)
    signs = [chr(c) for c in [*range(0x21, 0x250), 0x20, 0x0A, 0x0D, 0x3A9, 0x4E00]]
    common = [*"aeinrstAB019.,-é\n ", "'s", "'"]
    words = ["".join(rng.choice(signs if i % 3 else common, rng.integers(1, 9))) for i in range(20_000)]
    texts = ["x " + " ".join(words[i : i + 40]) for i in range(0, len(words), 40)] + ["x " + w for w in words]
    ids, counts = bpe.Codec(bpe.default_vocabulary()).encode_column(pa.array(texts))
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts))[:-1]] == [own_ids(t)[:-1] for t in texts]
