"""The corpus pipeline: rules, classifier, near-duplicates, benchmark overlaps, packing.

Each stage works on the rows that the one before kept, written as Parquet and read again.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinline.llm import bytecnn, jaccard_join, packing, quality_rules, spaced_seeds
from twinline.session import materialize
from twinline.sources.tables import scan_table

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
CONTEXT = 1024
GOOD = 0.7


def unused(docs: DataFrame, name: str) -> str:
    """``name``, or with underscores behind it the first that is no column."""
    while name in docs.columns:
        name += "_"
    return name


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules; null and empty texts fail them, and every row is judged alone."""
    if all(c in DOCUMENTS.split() for c in docs.columns):
        return quality_rules.judge(docs).filter("q_kept").select(docs.columns)
    # Other columns may have the names of the measures: they pass as one.
    whole = docs.select(F.struct(*docs.columns).alias("whole"), "text")
    return quality_rules.judge(whole).filter("q_kept").select("whole.*")


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network scores at least ``GOOD``; it is fitted on labelled rows of the whole table.

    Every row is scored alone, those with missing or repeated ids too; a score of exactly ``GOOD`` is kept.
    """
    table = scan_table(spark, f"{sf_dir}/documents.parquet", DOCUMENTS).filter(~bytecnn.held_out("doc_id", 4, 2))
    labels = scan_table(spark, f"{sf_dir}/labels.parquet", "doc_id long, quality int, toxic int")
    net = bytecnn.train(table, labels)
    score = unused(docs, "_score")
    return bytecnn.score(docs, net, name=score).filter(F.col(score) >= GOOD).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the smallest id, then the first row.

    Rows are told apart by their place in the table, so repeated and missing ids are no matter.
    """
    row = unused(docs, "_row")
    placed = docs.withColumn(row, F.monotonically_increasing_id())
    groups = jaccard_join.jaccard_components(placed.select(F.col(row).alias("_row"), "text"), doc_id="_row")
    owned = placed.select(F.col(row).alias("_row"), F.col("doc_id").alias("_id")).join(
        groups.select(F.col("doc_id").alias("_row"), "component_id"), "_row"
    )
    # A missing id is larger than any other.
    first = F.struct(F.col("_id").isNull().alias("x"), F.col("_id").alias("y"), F.col("_row").alias("row"))
    kept = owned.groupBy("component_id").agg(F.min(first).alias("k")).select(F.col("k.row").alias(row))
    return placed.join(kept, row, "left_semi").select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage; null and empty texts have none, and equal rows fare alike."""
    benchmark = scan_table(spark, f"{sf_dir}/benchmark.parquet", "item_id long, text string")
    overlaps = unused(docs, "_overlaps")
    marked = spaced_seeds.mark_overlaps(docs, benchmark, name=overlaps)
    return marked.filter(F.size(overlaps) == 0).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in windows of ``CONTEXT``: every row's, a null or empty text being its end id alone."""
    pieces = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), 0, CONTEXT)
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("quality_classifier", classifier),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("packing", pack),
]

#: A trained network decides one stage: no SQL gives the rows. ``tests/llm/test_pipeline.py`` rebuilds each stage's.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again; the pieces of the documents that all stages kept."""
    docs = scan_table(spark, f"{sf_dir}/documents.parquet", DOCUMENTS)
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
