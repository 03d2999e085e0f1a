"""Mixing sources to target weights by Pareto order sampling (DataFrame operations only).

Every source has a target number of words.  A document of a source is due
``target / source size`` copies (times its importance, if one is given), at most
``max_copies``: the whole part is certain, the fraction ``p`` is the inclusion
probability of one copy more.  Documents are put in the order of Pareto sampling,
random odds divided by inclusion odds

    ``(u / (1 - u)) / (p / (1 - p))``,

and the sample is the beginning of that order whose words fill what the certain
copies leave of the target.  ``u`` is a hash of the document's id, so reruns agree.

The order is never sorted as a whole.  Its place is a 48-bit key; a source's cut is
found in two histograms of ``2**12`` bins (sums per source and bin) and then among
the documents of one bin of ``2**24``, so no task holds more than that share of a
hot source; documents without a fraction stand in no bin.  What is joined back has one row
per source and is joined with a salt.  Sources are put in order by windows over one row a
source: meant for sources in their thousands, not for a source per document.

A text of any length counts whole.  Rows with one id and one source share their fate; ties in
place go by id.  An empty table gives an empty one.  Columns of ``sizes`` may not be named
``source_size``, ``target``, ``copies``, ``whole``, ``extra``, ``place`` or ``cut``; ``repeated`` takes any.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cyclestat.llm.common import stored, word_count

_KEY_BITS, _LEVEL_BITS = 48, 12
_SALTS = 32
#: Rounds in which copies above the limit are shared among the rest of a source.
_SHARE_ROUNDS = 6


def source_targets(sizes: DataFrame, weights: Sequence[float] = (1, 2, 3), max_copies: int = 3) -> DataFrame:
    """One row per source: ``source, source_size, target``.

    Sources in code-point order, null last, weigh ``weights`` in turn and share the
    sum of all sizes; a target stops at ``max_copies`` times its source's size and the
    excess goes to the others by weight.  With the sources in the order of the level
    at which they fill up, the level is a running sum.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    share = F.element_at(F.lit(list(map(float, weights))), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    caps = (
        sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("w", share)
        .withColumn("cap", F.col("source_size") * max_copies)
    )
    filling = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source")
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (
        F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    )
    full = caps.withColumn("level", level).withColumn("full", F.col("cap") <= F.col("w") * F.col("level"))
    rest = F.min(F.when(~F.col("full"), F.struct(F.col("cap") / F.col("w"), F.col("source").isNull(), F.col("source"), "level"))).over(everything)["level"]
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("w") * rest)
    return full.select("source", "source_size", target.alias("target"))


def _with_source(rows: DataFrame, per_source: DataFrame, id_col: str, how: str = "inner") -> DataFrame:
    """Join what each source has; a hot source's rows are spread over ``_SALTS`` keys."""
    salted = per_source.withColumnRenamed("source", "_source").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    on = rows["source"].eqNullSafe(salted["_source"]) & (F.pmod(F.hash(rows[id_col]), F.lit(_SALTS)) == salted["_salt"])
    return rows.join(salted, on, how).drop("_source", "_salt")


def _place(id_col: str, seed: int) -> Column:
    """Place in the Pareto order as an integer below ``2**48``; monotone in odds over odds."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))).cast("binary"))
    u = (F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << _KEY_BITS))
    p = F.col("extra")
    q = u * (1 - p) / (u * (1 - p) + (1 - u) * p)
    last = (1 << _KEY_BITS) - 1
    return F.when(p > 0, F.least(F.floor(q * float(1 << _KEY_BITS)), F.lit(last))).otherwise(F.lit(last)).cast("long")


def _due(sizes: DataFrame, id_col: str, max_copies: int) -> DataFrame:
    """Per source, the multiple of importance that gives the target words in expectation."""
    rate = F.when(F.col("iw_size") > 0, F.col("target") / F.col("iw_size")).otherwise(F.lit(0.0))
    per = sizes.groupBy("source").agg(F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.sum(F.col("size") * F.col("importance")).alias("iw_size"))
    per = per.select("source", rate.alias("rate"))
    for _ in range(_SHARE_ROUNDS):
        free = F.col("rate") * F.col("importance") < max_copies
        weighed = _with_source(sizes, per, id_col)
        full = F.sum(F.when(~free, F.col("size") * F.lit(float(max_copies))).otherwise(0.0))
        open_ = F.sum(F.when(free, F.col("size") * F.col("importance")).otherwise(0.0))
        per = weighed.groupBy("source").agg(F.first("target").alias("target"), F.first("rate").alias("rate"), full.alias("f"), open_.alias("o"))
        per = per.select("source", F.when(F.col("o") > 0, F.greatest("rate", (F.col("target") - F.col("f")) / F.col("o"))).otherwise(F.col("rate")).alias("rate"))
    return per


def plan_mix(
    sizes: DataFrame,
    id_col: str = "doc_id",
    weights: Sequence[float] = (1, 2, 3),
    max_copies: int = 3,
    seed: int = 1,
) -> DataFrame:
    """``sizes`` (``id_col, source, size`` and, if wanted, ``importance`` > 0) with ``source_size, target, copies``.

    A source with no words gets target 0.  Documents of size 0 follow the same order.
    Rows that share an id share their fate.  A null id is an id of its own.  Sizes and
    importances must not be null.  An empty table gives an empty one.
    """
    rows = _with_source(sizes, source_targets(sizes, weights, max_copies), id_col)
    if "importance" in sizes.columns:
        rows = stored(_with_source(rows, _due(rows, id_col, max_copies), id_col), "mix-due")
        due = F.least(F.col("rate") * F.col("importance"), F.lit(float(max_copies)))
    else:
        due = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(due)
    rows = rows.withColumn("whole", whole.cast("long")).withColumn("extra", due - whole).withColumn("place", _place(id_col, seed))
    cuts = _cuts(rows, id_col)
    taken = (F.col("extra") > 0) & (F.struct("place", F.col(id_col).alias("id")) <= F.col("cut"))
    out = _with_source(rows, cuts, id_col, "left")
    return out.select(*sizes.columns, "source_size", "target", (F.col("whole") + F.coalesce(taken, F.lit(False)).cast("long")).alias("copies"))


def _cuts(rows: DataFrame, id_col: str) -> DataFrame:
    """Per source with documents that have a fraction, the last place (and id) of the sample.

    A document is in when the words before it and half its own do not exceed what is
    left of the target: the sum then misses it by half a document at most.
    """
    shift1, shift2 = _KEY_BITS - _LEVEL_BITS, _KEY_BITS - 2 * _LEVEL_BITS
    left = rows.groupBy(F.col("source").alias("_source")).agg((F.first("target") - F.sum(F.col("size") * F.col("whole"))).alias("open"))
    rows = rows.where("extra > 0")  # documents with whole copies only are in no order
    bins = rows.groupBy("source", F.shiftright("place", shift1).alias("b")).agg(F.sum("size").alias("size"))
    bins = bins.join(left, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    cut = _cut_bin(bins, F.lit(0))
    inner = _with_source(rows, cut, id_col).where(F.shiftright("place", shift1) == F.col("b"))
    inner = inner.withColumnRenamed("b", "b1")
    bins = inner.groupBy("source", "b1", (F.shiftright("place", shift2) % (1 << _LEVEL_BITS)).alias("b")).agg(
        F.sum("size").alias("size"), F.first("open").alias("open"), F.first("before").alias("base")
    )
    cut2 = _cut_bin(bins, F.col("base"), "b1").select("source", F.shiftleft("b1", _LEVEL_BITS).alias("hi"), "b", "before", "open")
    cut2 = cut2.select("source", (F.col("hi") + F.col("b")).alias("b12"), "before", "open")
    last = _with_source(rows, cut2, id_col).where(F.shiftright("place", shift2) == F.col("b12"))
    last = last.groupBy("source", "place", id_col, "before", "open", "b12").agg(F.sum("size").alias("size"))
    upto = Window.partitionBy("source").orderBy("place", id_col).rowsBetween(Window.unboundedPreceding, -1)
    last = last.withColumn("prior", F.col("before") + F.coalesce(F.sum("size").over(upto), F.lit(0)))
    fits = 2 * F.col("prior") + F.col("size") <= 2 * F.col("open")
    place = F.struct("place", F.col(id_col).alias("id"))
    none = F.struct((F.shiftleft(F.first("b12"), shift2) - 1).alias("place"), F.lit(None).cast(rows.schema[id_col].dataType).alias("id"))
    return last.groupBy("source").agg(F.coalesce(F.max(F.when(fits, place)), none).alias("cut"))


def _cut_bin(bins: DataFrame, base: Column, *keep: str) -> DataFrame:
    """The first bin whose end is past ``open``, else the last one, and the words before it."""
    order = Window.partitionBy("source").orderBy("b")
    runs = bins.withColumn("end", base + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.withColumn("later", F.count(F.lit(1)).over(order.rowsBetween(1, Window.unboundedFollowing)))
    hit = (F.col("end") > F.col("open")) | (F.col("later") == 0)
    first = F.min(F.when(hit, F.struct("b", (F.col("end") - F.col("size")).alias("before"), "open", *keep)))
    return runs.groupBy("source").agg(first.alias("x")).select("source", "x.*")


def document_sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    return docs.select(F.col(id_col), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """Per document ``id_col, size, source, source_size, target, copies``; text is read once."""
    return plan_mix(stored(document_sizes(docs, id_col, text_col, source_col), "mix-sizes"), id_col, **options)


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mixed corpus: the rows of ``docs``, each as many times as the mix takes it.

    Which copies a row gets depends on its source and id alone, so rows with one id and
    one source get the same number.
    """
    plan = mix_documents(docs, id_col, text_col, source_col, **options)
    plan = plan.where("copies > 0").groupBy(F.col(id_col).alias("_id"), F.col("source").alias("_src")).agg(F.max("copies").cast("int").alias("_copies"))
    whole = docs.select(F.struct(*docs.columns).alias("_doc"), F.col(id_col).alias("_own_id"), F.col(source_col).alias("_own_src"))
    kept = whole.join(plan, F.col("_own_id").eqNullSafe(F.col("_id")) & F.col("_own_src").eqNullSafe(F.col("_src")))
    return kept.select("_doc", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("_doc.*")
