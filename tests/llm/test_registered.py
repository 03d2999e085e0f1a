"""The registered queries on a small folder of odd rows, every contract column against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from cyclestat.llm import bpe, queries
from cyclestat.llm.common import scratch
from test_minhash import classes, lowered, sets_of

WORD = re.compile("[^\x20\x09-\x0d]+")
SYLLABLES = {"aa": ["ka", "to", "mi", "ren"], "bb": ["sch", "un", "ge", "ber"], "zz": ["xy", "yx", "zq"]}


def crc(i):
    return None if i is None else zlib.crc32(str(i).encode())


def corpus():
    """Documents of two languages, one more that only held-out rows have, copies, nulls, repeated ids."""
    draw = random.Random(21)
    rows = []
    for i in range(150):
        lang = "zz" if i % 10 == 0 and crc(i) % 3 == 1 else draw.choice(["aa", "bb"])
        word = lambda: "".join(draw.choice(SYLLABLES[lang]) for _ in range(draw.randint(2, 4)))
        text = "\n".join(" ".join(word() for _ in range(draw.randint(1, 20))) for _ in range(draw.randint(1, 6)))
        if i % 8 == 3:
            text = rows[draw.randrange(len(rows))][1].title() + draw.choice(["", " end"])
        if i % 15 == 4:
            text += " # $ <a> | *" * draw.randint(1, 9) + "\nsame line\nsame line \n\n"
        rows.append((i, text, lang if i % 7 or lang == "zz" else None, f"s{i % 3}", len(text)))
    odd = [(900, None), (901, ""), (902, "12 ½ ²"), (903, "ka to " * 9_000), (904, rows[7][1]), (904, rows[9][1]), (None, rows[8][1]), (905, "Ⅷ"), (906, "    x" * 5)]
    return rows + [(i, t, None, None, None) for i, t in odd]


ROWS = corpus()


@pytest.fixture(scope="module")
def folder(spark):
    at = scratch(spark, "registered")
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    docs.write.parquet(f"{at}/documents.parquet")
    labels = [(r[0], int(r[0] % 5 > 0), 0) for r in ROWS[:150]]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    pages = [(i, f"u{i}", f"<html><body><nav>menu</nav><article><h1>T{i}</h1><p>{'w &amp; ' * (i + 3)}</p></article></body></html>") for i in range(30)] + [(None, None, None)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{at}/pages.parquet")
    return at


def run(spark, folder, name):
    return queries.QUERIES[name](spark, folder).collect()


def by_id(rows, value):
    """Values per id, as sorted lists: ids repeat and one is null."""
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(value(r))
    return {k: sorted(v, key=str) for k, v in out.items()}


def test_op1(spark, folder):
    got = run(spark, folder, "op1_piece_langid")
    assert len(got) == len(ROWS)
    assert by_id([(r.doc_id, r.held_out) for r in got], lambda r: r[1]) == by_id(ROWS, lambda r: crc(r[0]) is not None and crc(r[0]) % 3 == 1)
    assert any(r[2] == "zz" for r in ROWS) and {r.lang_pred for r in got} == {"aa", "bb", "und"}  # zz is only in held-out rows
    und = {r.doc_id for r in got if r.lang_pred == "und"}
    assert und == {900, 901, 902, 905} and all(0 <= r.score <= 1 for r in got)
    right = [(r.lang_pred, ROWS[r.doc_id][2]) for r in got if r.doc_id is not None and r.doc_id < 150 and r.held_out and ROWS[r.doc_id][2] not in (None, "zz")]
    assert sum(a == b for a, b in right) / len(right) > 0.9


def encoded():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_vocabulary())
    library.no_truncation()
    library.no_padding()
    return library, [library.encode(r[1] or "", add_special_tokens=False).ids for r in ROWS]


def test_op2(spark, folder):
    library, ids = encoded()
    want = [(r[0], len(x), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in x)).hexdigest(), hashlib.sha256(library.decode(x, skip_special_tokens=False).encode()).hexdigest()) for r, x in zip(ROWS, ids)]
    got = [(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in run(spark, folder, "op2_bpe_tree")]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_op8(spark, folder):
    _, ids = encoded()
    order = sorted(range(len(ROWS)), key=lambda k: (ROWS[k][0] is not None, ROWS[k][0] or 0, ROWS[k][1] is not None, ROWS[k][1] or ""))
    want, start = [], 0
    for k in order:
        own = [*ids[k], 0]
        want.append((ROWS[k][0], start, len(own), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in own))))
        start += len(own)
    got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in run(spark, folder, "op8_token_files")]
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("name, percent", [("op4_minhash", 85), ("op11_ngram_join", 90)])
def test_op4_op11(spark, folder, name, percent):
    got = run(spark, folder, name)
    want = classes([(i, t) for i, t, *_ in ROWS if i is not None], 3, percent)
    assert by_id([(r.doc_id, (r.n_shingles, r.component_id)) for r in got], lambda r: r[1]) == by_id(ROWS, lambda r: (len(sets_of(r[1], 3)), want.get(r[0])))
    if name == "op4_minhash":
        assert all(r.kept == (r.component_id == r.doc_id) for r in got)
    assert len(set(want.values())) < len(want) - 10


def test_op6(spark, folder):
    def base(text):
        words = WORD.findall(text or "")
        seen, dup = set(), 0
        for line in (text or "").split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        repeated = set()
        for i in range(len(words) - 4):
            if windows[tuple(words[i : i + 5])] > 1:
                repeated |= set(range(i, i + 5))
        n = len(words)
        return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(repeated), n < 10 or 100 * len(repeated) > 20 * n

    got = run(spark, folder, "op6_quality")
    value = lambda r: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
    assert by_id([(r.doc_id, value(r)) for r in got], lambda r: r[1]) == by_id(ROWS, lambda r: base(r[1]))
    assert not any(r.kept and r.base_failed for r in got) and any(r.kept for r in got)


def test_op7(spark, folder):
    tokens = [[*WORD.findall(lowered(r[1] or "")), None] for r in ROWS]
    held = [crc(r[0]) is not None and crc(r[0]) % 5 == 1 for r in ROWS]
    counts = Counter(t for own, out in zip(tokens, held) if not out for t in own)
    total, distinct = sum(counts.values()), len(counts)
    want = [
        (r[0], out, len(own), sum(counts[t] > 0 for t in own), total, round(sum(math.log10((counts[t] + 0.5) / (total + 0.5 * (distinct + 1))) for t in own), 4))
        for r, own, out in zip(ROWS, tokens, held)
    ]
    rows = run(spark, folder, "op7_lbl_score")
    got = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert all(math.isfinite(r.score) and r.score < 0 for r in rows)


def test_op9(spark, folder):
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in run(spark, folder, "op9_main_text")}
    for i in range(30):
        text = f"T{i}\n\n" + " ".join(["w &"] * (i + 3))
        assert got[i] == (f"u{i}", text, len(text))
    assert got[None] == (None, "", 0)
