"""The corpus pipeline: documents to kept, deduplicated, mixed and encoded documents.

Each stage is ``(spark, docs, sf_dir) -> DataFrame`` over all its predecessor kept; what it
returns is written as Parquet and read again as the next one's ``docs``.  All but the last
return the columns of ``docs``, whatever else than ``doc_id, text, lang, source`` they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cyclestat.llm import bpe, langid, line_dedup, minhash, mixing
from cyclestat.llm.common import read_table, stored


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language (operator 1): those without a letter, or with no likely language, go.

    Learned from all rows that have a language.  Where none has one, nothing can be
    learned and every document goes.
    """
    model = langid.fit(docs)
    own = [f"c{i}" for i in range(len(docs.columns))]  # any column may be named as the result's
    out = langid.predict(docs.toDF(*own), model, own, own[docs.columns.index("text")]).where(langid.accepted())
    return out.select(*own).toDF(*docs.columns)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three documents or more share go, except in the largest doc_id (operator 10)."""
    return line_dedup.drop_repeated_lines(docs).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, the smallest doc_id (operator 4).

    Five words a shingle, similarity 0.8 or more.  Rows that repeat a doc_id are one
    document, of which the row with the least text stays (null last); rows without a doc_id stay.
    """
    found = minhash.NearDuplicates(shingle=5, percent=80).find(docs)
    first = found.where("component_id = doc_id").select(F.col("doc_id").alias("_first")).distinct()
    whole = docs.select(F.struct(*docs.columns).alias("doc"), "doc_id", F.struct(F.col("text").isNull(), "text").alias("place"))
    kept = whole.join(first, F.col("doc_id") == F.col("_first")).groupBy("doc_id").agg(F.min_by("doc", "place").alias("doc"))
    return kept.select("doc.*").union(docs.where("doc_id IS NULL"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: each document as often as the mix takes it (operator 3)."""
    return mixing.repeated(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every copy's token ids, decoded again to prove them (operator 2)."""
    out = bpe.encode_and_decode(docs, ["doc_id", "source"], cached=300_000)
    return out.select(
        "doc_id", "source", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), "ids"
    )


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup),
    ("mix", mix),
    ("encode", encode),
]

#: Language ID, near duplicates and tokens can't be expressed in SQL; tests/llm compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
