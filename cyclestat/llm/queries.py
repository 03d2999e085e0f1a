"""The registered queries: each applies its operator to a whole table of the test data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cyclestat.llm import bpe, htmltext, langid, line_dedup, lm, merkle, minhash, mixing, ngram_join, quality, spelling, tokenfiles, topk
from cyclestat.llm.common import id_remainder, in_task, read_table, scratch, stored


def op1_piece_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held_out = F.coalesce(id_remainder("doc_id", 3) == 1, F.lit(False))
    model = langid.fit(docs.where(~held_out).select("doc_id", "text", "lang"))
    out = langid.predict(docs.select("doc_id", "text"), model, ["doc_id"])
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op2_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.encode_and_decode(read_table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])
    return out.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    )


def op3_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    mix = mixing.mix_documents(docs)
    return mix.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = minhash.NearDuplicates(shingle=3, percent=85, rows=9).find(docs)
    return found.withColumn("kept", F.col("component_id").eqNullSafe(F.col("doc_id")))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(vectors, F.col("vec_id") % 50 == 0, k=5)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", F.col("lang").alias("stratum"))
    labels = read_table(spark, sf_dir, "labels").select(F.col("doc_id").alias("_id"), "quality").where("quality = 1")
    measured = stored(quality.measure(docs, ["doc_id", "stratum"]), "quality-measured")
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    holdout = measured.join(labels, F.col("doc_id") == F.col("_id"), "left_semi")
    cuts = quality.cutoffs(holdout, ~base)
    out = quality.judged(measured, cuts).withColumn("base_failed", base)
    kept = ~F.col("base_failed") & (F.size("rejected_by") == 0)
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return out.select(*columns, kept.alias("kept"), F.array_join("rejected_by", ",").alias("rejected_by"))


def op7_lbl_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    fitted = lm.fit(docs.where(lm.learns()))
    out = lm.score(docs, fitted, ["doc_id"])
    return out.select("doc_id", (~lm.learns()).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    folder = scratch(spark, "token-files")
    tokenfiles.write_corpus(docs, folder, end_id=0)
    return tokenfiles.read_corpus(spark, folder, digest=True)


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    out = htmltext.extract(pages, htmltext.fit(pages), ["page_id", "url"])
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op10_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup.drop_repeated_lines(docs)
    text = F.coalesce(F.col("text"), F.lit(""))
    return out.select(
        "doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2(text.cast("binary"), 256).alias("kept_sha256")
    )


def op11_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return ngram_join.JaccardJoin(shingle=3, percent=90).find(docs)


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return spelling.variants(spelling.counted(spelling.with_slips(spelling.runs(docs))))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    shorter = [F.translate("text", "\n", "") if c == "text" else F.col(c) for c in fields]
    tampered = F.when(id_remainder("doc_id", 2) == 0, merkle.leaf(shorter))
    manifest = merkle.DatasetManifest(docs, "doc_id", "source", fields, [tampered.alias("tampered")])
    proofs = manifest.proofs().select(F.col("row.id").alias("doc_id"), F.col("node").alias("leaf"), "subroot", "path", F.coalesce("row.tampered", "node").alias("claimed"))
    kind = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, leaf string, subroot string, claimed string, folded string, proof string"
    out = proofs.mapInArrow(in_task("merkle", "folded", "claimed"), kind)
    root = F.lit(manifest.root).cast("string")
    return out.select("doc_id", "leaf", "subroot", root.alias("root"), F.col("proof").alias("proof_sha256"), F.col("folded").alias("folded_root"), (F.col("folded") == root).alias("verified"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_piece_langid,
        op2_bpe_tree,
        op3_pareto_mix,
        op4_minhash,
        op5_topk,
        op6_quality,
        op7_lbl_score,
        op8_token_files,
        op9_main_text,
        op10_line_runs,
        op11_ngram_join,
        op12_spelling,
        op13_merkle,
    )
}
