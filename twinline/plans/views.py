"""The given tables read as pair corpora, loss logs, sessions and scored segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinline.operators.clean import nonempty_pairs, normalize_pairs
from twinline.sources.tables import scan_table

# Declared schemas: nothing is inferred.
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
CONVERSATIONS = "conv_id long, turn long, role string, text string"
LABELS = "doc_id long, quality int, toxic int"
EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"

FIRST_DAY = "2024-01-01"
WITHHELD_ABOVE = 0.12


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_table(spark, f"{sf_dir}/documents.parquet", DOCUMENTS)


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user turn with the assistant turn that follows it, as ``id, dialect, english``."""
    turns = scan_table(spark, f"{sf_dir}/conversations.parquet", CONVERSATIONS)
    # Counted, so that no two turns share an id however long a conversation is.
    span = turns.agg(F.coalesce(F.max("turn"), F.lit(0)) + 1).scalar()
    asked = turns.filter("role = 'user'").select(
        "conv_id", "turn", (F.col("conv_id") * span + F.col("turn")).alias("id"), F.col("text").alias("dialect")
    )
    answered = turns.filter("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("english")
    )
    return asked.join(answered, ["conv_id", "turn"]).select("id", "dialect", "english")


def chat_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`pairs` as ``ord, src, tgt``, stripped and non-empty."""
    raw = pairs(spark, sf_dir).withColumnRenamed("id", "ord")
    return normalize_pairs(nonempty_pairs(raw, "dialect", "english"), "dialect", "english")


def raw_doc_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First line of each document against the rest; a single line gives two empty sides."""
    return document_sides(documents(spark, sf_dir))


def document_sides(docs: DataFrame) -> DataFrame:
    """Documents as pairs; see :func:`raw_doc_pairs`. Also works on streams."""
    at = F.locate("\n", F.col("text"))
    return docs.select(
        F.col("doc_id").alias("ord"),
        F.col("lang").alias("category"),
        "source",
        F.when(at > 0, F.substring_index("text", "\n", 1)).otherwise("").alias("src"),
        F.when(at > 0, F.substring(F.col("text"), at + 1, F.length("text"))).otherwise("").alias("tgt"),
    )


def doc_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-empty document pairs: copies included."""
    filled = nonempty_pairs(raw_doc_pairs(spark, sf_dir))
    return normalize_pairs(filled, keep=("ord", "category", "source"))


def category_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document pairs by language and source."""
    return doc_pairs(spark, sf_dir).select(
        F.concat_ws("/", "category", "source").alias("category"), "ord", "src", "tgt"
    )


def loss_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as steps of training runs, one epoch a day."""
    events = scan_table(spark, f"{sf_dir}/events.parquet", EVENTS)
    return events.select(
        F.col("event_type").alias("run"),
        (F.date_diff(F.col("ts").cast("date"), F.lit(FIRST_DAY).cast("date")) + 1).alias("epoch"),
        F.col("event_id").alias("step"),
        F.floor(F.col("event_id") / 16).alias("batch"),
        F.col("value").alias("loss"),
    )


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source as a collection session; many toxic labels withhold consent."""
    labels = scan_table(spark, f"{sf_dir}/labels.parquet", LABELS)
    labelled = documents(spark, sf_dir).select("doc_id", "source").join(labels, "doc_id")
    return labelled.groupBy(F.col("source").alias("session_id")).agg(
        F.count("*").alias("n_labelled"), (F.avg("toxic") <= WITHHELD_ABOVE).alias("consent")
    )


def _thinned(text: str, key: str) -> Column:
    """The text without every k-th word, k from 3 to 7."""
    kept = F.filter(F.split(text, " "), lambda w, i: (i + 1) % (F.col(key) % 5 + 3).cast("int") != 0)
    return F.array_join(kept, " ")


def hypotheses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thinned documents."""
    return documents(spark, sf_dir).select(
        F.col("doc_id").alias("seg_id"), _thinned("text", "doc_id").alias("hypothesis")
    )


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select(
        F.col("doc_id").alias("seg_id"),
        F.col("lang").alias("category"),
        F.substring_index("text", "\n", 1).alias("src"),
        F.col("text").alias("reference"),
    )

