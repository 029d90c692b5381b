"""Profiles of a pair table: counts, empties, lengths, words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinline.functions.sequences import MAX_LEN
from twinline.functions.text import is_filled, word_count, words


def profile_pairs(df: DataFrame, src: str = "src", tgt: str = "tgt") -> DataFrame:
    """Rows, empty cells by side and the column list, in one pass."""
    no_src, no_tgt = ~is_filled(F.col(src)), ~is_filled(F.col(tgt))
    return df.agg(
        F.count("*").alias("n_pairs"),
        F.count_if(no_src).alias("empty_src"),
        F.count_if(no_tgt).alias("empty_tgt"),
        F.count_if(no_src | no_tgt).alias("empty_either"),
        F.first(F.lit(",".join(df.columns))).alias("columns"),
    )


def sample_pairs(df: DataFrame, n: int = 5) -> DataFrame:
    """The first ``n`` pairs by ``ord``."""
    return df.orderBy("ord").limit(n)


def word_counts(df: DataFrame) -> DataFrame:
    return df.select(
        "ord",
        word_count(F.col("src")).alias("src_words"),
        word_count(F.col("tgt")).alias("tgt_words"),
    )


def stack_sides(df: DataFrame, keep: tuple[str, ...] = ("ord",)) -> DataFrame:
    """One row per non-empty sentence: both sides as a single corpus."""
    sides = F.array(
        *[F.struct(F.lit(s).alias("side"), F.col(s).alias("text")) for s in ("src", "tgt")]
    )
    return df.select(*keep, F.inline(sides)).filter(is_filled(F.col("text")))


def corpus_sides(df: DataFrame) -> DataFrame:
    """Number of sentences by side."""
    return stack_sides(df).groupBy("side").agg(F.count("*").alias("n_sentences"))


def length_profile(df: DataFrame, max_len: int = MAX_LEN) -> DataFrame:
    """Exact word-length percentiles by side, and the share of sentences a pack would cut.

    Lengths are first reduced to a histogram, so the percentile state stays small.
    """
    histogram = (
        stack_sides(df)
        .select("side", word_count(F.col("text")).alias("n"))
        .groupBy("side", "n")
        .agg(F.count("*").alias("freq"))
    )
    quantile = lambda p: F.percentile("n", F.lit(p), F.col("freq"))
    return histogram.groupBy("side").agg(
        F.sum("freq").alias("n_sentences"),
        quantile(0.5).alias("p50"),
        quantile(0.99).alias("p99"),
        F.max("n").alias("longest"),
        F.round(
            F.sum(F.when(F.col("n") > max_len - 2, F.col("freq")).otherwise(0)) / F.sum("freq"), 6
        ).alias("cut_share"),
    )


def word_vocab_size(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Distinct words by side, as a word-level vocabulary would hold them."""
    tokens = stack_sides(df).select("side", F.explode(words(F.col("text"))).alias("word"))
    if approximate:
        return tokens.groupBy("side").agg(F.approx_count_distinct("word").alias("n_words"))
    distinct = tokens.groupBy("side", "word").agg(F.count("*").alias("freq"))
    return distinct.groupBy("side").agg(F.count("*").alias("n_words"))
