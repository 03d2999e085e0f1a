"""Spelling variants: words one edit apart, by permuterm rotations.

Rotations.  A word marked with a terminator, ``w$``, has a rotation for each of its code points and one
for the mark.  Skip the last code point ``c`` of a rotation ``s$pc`` and ``s$p`` is left: the words ``p?s`` are
the rotations that continue ``s$p`` by one code point, and the word ``ps`` is the rotation that ends there.
So in the sorted rotations the prefix range of ``s$p``, one code point further, holds exactly the words
that differ from each other by replacing that code point, with the word that lacks it.

Every word's rotations are sorted by what is left (key) and scanned range by range.  A range holds a
row per word and at most one word per letter of the alphabet and the one without, so it is bounded by
the alphabet, whatever the corpus.  No pairs are made: a range gives each of its words its number of
neighbours there and the best of them, the first of the range or, for the first itself, the second.
Words that lose one of a run of equal letters meet in several ranges; the pair counts where the
first of the run is skipped.

Forms.  A word's form is its near word of largest count (ties: smallest in code-point order), if
that count is at least ``ratio`` times the word's own.  Along forms counts grow by that factor, so a way to
the root is short; it is found by doubling.

Results.  A null or empty text has no words.  Texts are split whole, whatever their length; words of a
row that is repeated count again.  An empty table gives no rows.  Only the two named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cyclestat.llm.common import LOWER, UPPER, stored

#: Letters a word is made of; only A-Z are lowered.
LETTERS = "A-Za-zÀ-ÿ"
#: Marks a word's end; not a letter.
MARK = "$"


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 7) -> DataFrame:
    """``id, run``: the maximal runs of ``least`` letters or more of every text, A-Z lowered."""
    found = F.regexp_extract_all(F.col(text_col), F.lit(f"[{LETTERS}]{{{least},}}"), F.lit(0))
    each = docs.select(F.col(id_col).alias("id"), F.explode(found).alias("run"))
    return each.select("id", F.translate("run", UPPER, LOWER).alias("run"))


def with_slips(each: DataFrame, one_in: int = 31) -> DataFrame:
    """``word``: the runs, of which the crc32 of ``id:run`` chooses some to lose a code point (null id: as empty text)."""
    h = F.crc32(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    hashed = each.select("run", h.alias("h"), F.length("run").alias("m"))
    at = (F.col("h") % F.col("m")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.col("m")))
    return hashed.select(F.when(F.col("h") % one_in == 0, cut).otherwise(F.col("run")).alias("word"))


def counted(words: DataFrame, length: int = 7, occurrences: int = 2) -> DataFrame:
    """``word, n`` of words of at least that length and number."""
    return words.where(F.length("word") >= length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= occurrences)


def rotations(vocabulary: DataFrame) -> DataFrame:
    """``key, skipped, first, word, n``: each rotation without its last letter (``skipped``), and whole (null).

    ``first``: the letter before the skipped one is another.
    """
    m = F.length("word")
    letter: Column = lambda i: F.substring(F.col("word"), i, F.lit(1))
    rotated = lambda head, tail: F.concat(F.substring(F.col("word"), tail, m), F.lit(MARK), F.substring(F.col("word"), F.lit(1), head))
    cut = F.transform(
        F.sequence(F.lit(1), m),
        lambda i: F.struct(rotated(i - 1, i + 1).alias("key"), letter(i).alias("skipped"), ((i == 1) | (letter(i) != letter(i - 1))).alias("first")),
    )
    whole = F.transform(F.sequence(F.lit(0), m), lambda i: F.struct(rotated(i, i + 1).alias("key"), F.lit(None).cast("string").alias("skipped"), F.lit(False).alias("first")))
    return vocabulary.select("word", "n", F.explode(F.concat(cut, whole)).alias("r")).select("r.*", "word", "n")


def neighbours(vocabulary: DataFrame) -> DataFrame:
    """``word, n_near, near_n, near``: how many near words, and the best, of words that have one."""
    n = int(vocabulary.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a few files of words are many rotations
    rows = rotations(vocabulary.repartition(n, "word")).withColumn("best", F.struct((-F.col("n")).alias("m"), "word"))
    key = Window.partitionBy("key")
    ranked = key.orderBy("best")
    all_ranked = ranked.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    seen = rows.select(
        "word",
        "skipped",
        "first",
        F.row_number().over(ranked).alias("nth"),
        F.first("best").over(all_ranked).alias("one"),
        F.nth_value("best", 2).over(all_ranked).alias("two"),
        F.count("skipped").over(all_ranked).alias("n_skipped"),
        F.count(F.when(F.col("first"), 1)).over(all_ranked).alias("n_first"),
        F.count(F.when(F.col("skipped").isNull(), 1)).over(all_ranked).alias("n_whole"),
    ).where("two IS NOT NULL")
    whole = F.col("skipped").isNull()
    near = F.when(whole, F.col("n_first")).otherwise(F.col("n_skipped") - 1 + F.when(F.col("first"), F.col("n_whole")).otherwise(0))
    other = F.when(F.col("nth") == 1, F.col("two")).otherwise(F.col("one"))
    out = seen.groupBy("word").agg(F.sum(near).alias("n_near"), F.min(other).alias("best"))
    return out.select("word", "n_near", (-F.col("best.m")).alias("near_n"), F.col("best.word").alias("near"))


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` for links ``word, form`` without cycles: the last form on the way."""
    now = stored(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = now.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        step = stored(now.join(on, F.col("root") == F.col("_word"), "left").select("word", F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("went")), "spelling-roots")
        if step.where("went").isEmpty():
            return step.select("word", "root")
        now = step.select("word", "root")


def variants(vocabulary: DataFrame, ratio: int = 10) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of each word of ``vocabulary`` (``word, n``)."""
    vocabulary = stored(vocabulary, "spelling-words")
    found = vocabulary.join(neighbours(vocabulary), "word", "left")
    has = F.col("near_n") >= ratio * F.col("n")
    found = stored(
        found.select("word", F.when(has, F.col("near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("near_n")).alias("form_n")),
        "spelling-found",
    )
    last = roots(found.where("form IS NOT NULL"))
    return found.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
