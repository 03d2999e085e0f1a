"""BPE encoding: exact against the library, whatever the piece size, and a round trip."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cyclestat.llm import bpe

CODEC = bpe.Codec.of(bpe.default_vocabulary())
ALPHABET = st.sampled_from(list("abtheing 'sdlv.,!\"\n\t 019é日ßЖ<|>　 \x1f")) | st.sampled_from([" the", "'ll", "  ", "'", "''", "<|endoftext|>", "!!!", "ing", "ll", "ve ", "👍", "\r\n"])
TEXTS = st.lists(ALPHABET, max_size=60).map("".join)


def library(text: str) -> list[int]:
    return CODEC.library.encode(text, add_special_tokens=False).ids


def by_tree(text: str, piece: int) -> list[int]:
    cuts = CODEC.cuts(text, piece)
    begin, parts = 0, []
    for (end, inside), before in zip(cuts, [False, *[i for _, i in cuts]]):
        ids, first, last = CODEC.leaf(text[begin:end], inside or before)
        parts.append(((np.frombuffer(ids, "<u4"), first, last), inside))
        begin = end
    joined, inside = parts[0]
    for other, inside_next in parts[1:]:
        joined = CODEC.join(joined, other, inside)
        inside = inside_next
    return joined[0].tolist()


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_leaves_equal_the_library(text):
    assert np.frombuffer(CODEC.encode([text])[0], "<u4").tolist() == library(text)
    assert CODEC.decode(CODEC.encode([text])[0]) == CODEC.library.decode(library(text), skip_special_tokens=False) == text


def test_white_space_chunks_learned_in_one_call():
    """Neighbours of white space alone must not become one run when they are learned together."""
    texts = [*(" \xa0" * k for k in range(1, 10)), *(" \u3000" * k + "\xa0" for k in range(1, 10)), " word", " \xa0 one"]
    fresh = bpe.Codec(bpe.default_vocabulary())
    for text, ids in zip(texts, fresh.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == library(text)
        assert fresh.decode(ids) == text


@settings(max_examples=300, deadline=None)
@given(TEXTS, st.integers(8, 40))
def test_tree_equals_the_library(text, piece):
    assert by_tree(text, piece) == library(text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abtheins", max_size=300) | st.text(alphabet="01234", max_size=200) | st.text(alphabet="!?.*'", max_size=200) | st.text(alphabet="日本語éß", max_size=200) | st.text(alphabet=" \n", max_size=200), st.integers(8, 30))
def test_unsplit_runs(text, piece):
    assert by_tree(text + "x", piece) == library(text + "x")
    assert by_tree("a " + text, piece) == library("a " + text)


@pytest.mark.parametrize("text", ["a" * 70_000, "thein" * 9_000, " " * 40_000 + "x", "'" * 9_000 + "s", "日本" * 9_000, "12" * 20_000])
def test_very_long_runs(text):
    want = library(text)
    assert by_tree(text, 5_000) == want
    assert np.frombuffer(CODEC.encode([text])[0], "<u4").tolist() == want


def test_table(spark):
    texts = [None, "", "one two", "x" * 5_000, "a b " * 3_000, "é" * 3_000 + " end", "q <|endoftext|> r " * 300, "a b " * 3_000]
    docs = spark.createDataFrame([(i % 7, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, ids_ string")
    got = bpe.encode_and_decode(docs, ["doc_id", "ids_"], piece=1_000).collect()
    assert len(got) == len(texts)
    want = sorted((i % 7, len(library(t or "")), hashlib.sha256(np.array(library(t or ""), "<u4").tobytes()).hexdigest(), t or "") for i, t in enumerate(texts))
    assert sorted((r.doc_id, r.n_tokens, hashlib.sha256(r.ids).hexdigest(), r.decoded) for r in got) == want


def test_empty_table_and_clash(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, ids string")
    assert bpe.encode_and_decode(docs, ["doc_id"]).collect() == []
    with pytest.raises(ValueError):
        bpe.encode_and_decode(docs, ["doc_id", "ids"])
