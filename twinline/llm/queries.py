"""The named queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinline.llm import (
    bytecnn, jaccard_join, lbl, merkle, packing, pii, quality_rules, quotes, sharding, spaced_seeds, token_files,
    vector_codes, warc,
)
from twinline.session import scratch_path
from twinline.sources.tables import scan_table

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
PAGES = "page_id long, url string, html string"
LABELS = "doc_id long, quality int, toxic int"
BENCHMARK = "item_id long, text string"
EMBEDDINGS = "vec_id long, embedding array<float>, label int"
CONVERSATIONS = "conv_id long, turn long, role string, text string"

SHARD_BYTES = 1 << 20
GOOD = 0.7


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_table(spark, f"{sf_dir}/documents.parquet", DOCUMENTS)


def op1_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).withColumn("held", bytecnn.held_out("doc_id", 5, 1))
    return lbl.score(docs, lbl.learn(docs.filter(~F.col("held"))), "doc_id", "text", "held")


def op2_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", F.octet_length("text").alias("size"))
    return sharding.assign_shards(docs, "doc_id", F.col("size"), SHARD_BYTES).drop("size")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), 0)
    crc = F.crc32("ids").alias("ids_crc32")
    return pieces.select("doc_id", "start", "length", crc, "doc_tokens", "sequence_id", "offset")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(_documents(spark, sf_dir).select("doc_id", "text"))
    return judged.select(
        "doc_id", F.col("q_words").alias("n_words"), F.col("q_word_chars").alias("word_chars"),
        F.col("q_symbols").alias("n_symbols"), F.col("q_dup_lines").alias("n_dup_lines"),
        F.col("q_repeat_words").alias("n_repeat_words"), F.col("q_base_failed").alias("base_failed"),
        F.col("q_kept").alias("kept"),
    )


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(_documents(spark, sf_dir)).drop("n_links")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_warc(scan_table(spark, f"{sf_dir}/pages.parquet", PAGES), path)
    return warc.read_warc(spark, path, payloads=False).drop("url", "html")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).withColumn("held_out", bytecnn.held_out("doc_id", 4, 2))
    labels = scan_table(spark, f"{sf_dir}/labels.parquet", LABELS)
    net = bytecnn.train(docs.filter(~F.col("held_out")), labels)
    scored = bytecnn.score(docs.select("doc_id", "held_out", "text"), net)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))


def op8_quotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.format_chats(scan_table(spark, f"{sf_dir}/conversations.parquet", CONVERSATIONS))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    marked = spaced_seeds.mark_overlaps(docs, scan_table(spark, f"{sf_dir}/benchmark.parquet", BENCHMARK))
    return marked.select(
        "doc_id", (F.size("overlaps") > 0).alias("contaminated"),
        F.transform("overlaps", lambda x: x["item_id"]).alias("item_ids"),
        F.transform("overlaps", lambda x: x["matched"]).alias("matched"),
        F.transform("overlaps", lambda x: x["first_word"]).alias("first_words"),
        F.transform("overlaps", lambda x: x["end_word"]).alias("end_words"),
    )


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    docs = _documents(spark, sf_dir)
    token_files.write_token_files(docs, path, public_tokenizers.path("word_bpe_49k.json"), 2)
    rows = token_files.read_token_files(spark, path)
    read = rows.mapInArrow(token_files.crc_of_lists, "doc_id long, start long, n_tokens long, ids_crc32 long")
    return read


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proof of every document and the root folded from its tampered form."""
    return merkle.manifest(merkle.document_leaves(_documents(spark, sf_dir)))


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digest of the base findings, and all spans."""
    found = pii.detect(_documents(spark, sf_dir))
    # No default argument in the lambda: Spark would hand it the place in the array.
    of_kind = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    counts = [of_kind(k).alias(f"n_{kind}") for k, kind in enumerate(pii.KINDS)]
    digest = F.sha2(pii.span_text(F.col("base")), 256).alias("base_sha256")
    return found.select("doc_id", *counts, digest, pii.span_text(F.col("spans")).alias("spans"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product codes and errors of the embeddings."""
    return vector_codes.compress(scan_table(spark, f"{sf_dir}/embeddings.parquet", EMBEDDINGS))


def registry() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_lm_scores, op2_shards, op3_packing, op4_quality_rules, op5_jaccard_join, op6_warc,
            op7_quality_classifier, op8_quotations, op9_decontamination, op10_token_files, op11_merkle_manifest,
            op12_pii, op13_vector_codes,
        )
    }
