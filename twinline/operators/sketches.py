"""Profiles that grow with deliveries: sketches stored as columns and merged, so that old pairs are not read again.

Lengths are held as quantile sketches, words as distinct-count sketches, both by side and category. Merging the
sketches of several deliveries gives the profile of them all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinline.functions.text import word_count, words
from twinline.operators.profile import stack_sides

QUANTILE_K = 400  # rank error under 1 %
DISTINCT_BITS = 14  # 2^14 registers: a relative standard error of about 0.65 %
KEYS = ("category", "side")


def delivery_sketches(pairs: DataFrame) -> DataFrame:
    """``category, side, n_sentences, lengths, vocabulary`` of one delivery; the last two are binary sketches."""
    sides = stack_sides(pairs, keep=("category",))
    lengths = sides.groupBy(*KEYS).agg(
        F.count("*").alias("n_sentences"), F.kll_sketch_agg_bigint(word_count(F.col("text")).cast("long"), QUANTILE_K).alias("lengths")
    )
    tokens = sides.select(*KEYS, F.explode(words(F.col("text"))).alias("word"))
    vocabulary = tokens.groupBy(*KEYS).agg(F.hll_sketch_agg("word", DISTINCT_BITS).alias("vocabulary"))
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"v.{k}")) for k in KEYS]
    joined = lengths.alias("l").join(vocabulary.alias("v"), same, "left")
    return joined.select("l.*", "v.vocabulary")


def merged_sketches(deliveries: DataFrame, *keys: str) -> DataFrame:
    """Sketches of all deliveries by ``keys`` (default: category and side)."""
    keys = keys or KEYS
    return deliveries.groupBy(*keys).agg(
        F.sum("n_sentences").alias("n_sentences"),
        F.kll_merge_agg_bigint("lengths").alias("lengths"),
        F.hll_union_agg("vocabulary").alias("vocabulary"),
    )


def sketch_report(merged: DataFrame) -> DataFrame:
    """Sentences, the lengths' median and 99th percentile, and distinct words, of each row of sketches."""
    quantile = lambda p: F.kll_sketch_get_quantile_bigint("lengths", F.lit(p))
    kept = [c for c in merged.columns if c not in ("lengths", "vocabulary")]
    return merged.select(
        *kept, quantile(0.5).alias("p50"), quantile(0.99).alias("p99"), F.hll_sketch_estimate("vocabulary").alias("n_words")
    )
