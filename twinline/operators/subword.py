"""Shared subword vocabulary: word table, character coverage, merge learning.

Pair counts on their own (:func:`pair_counts`) see each distinct word as one string in
which every symbol is wrapped in two control characters. Folding removes these from
text, so they are safe marks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinline.functions.sequences import BOS, EOS, PAD, UNK
from twinline.functions.text import nfkc_fold
from twinline.operators import merging
from twinline.operators.profile import stack_sides
from twinline.session import discard, store

# Names of the special tokens, protected digits, vocabulary size, coverage,
# the mark that opens a word, and the text shown for an unknown token.
SPECIALS = ((PAD, "<PAD>"), (UNK, "<UNK>"), (BOS, "<BOS>"), (EOS, "<EOS>"))
PROTECTED = ("3", "7", "9", "5")
VOCAB_SIZE = 16_000
COVERAGE = 0.9995
WORD_MARK = "▁"
UNKNOWN_TEXT = " ⁇ "

_OPEN, _CLOSE = "\x01", "\x02"
_UNKNOWN = "\x03"  # stands for a character outside the vocabulary
RAW_SPLIT = r"[ \t\n\f\r]+"  # whitespace that folding turns into a space
MERGES_SCHEMA = "rank int, left string, right string, freq long"
VOCAB_SCHEMA = "id int, piece string, kind string"


def word_freq(pairs: DataFrame) -> DataFrame:
    """Folded words of both sides and their counts.

    Raw words are counted first, so that Python folds each distinct word once.
    """
    tokens = stack_sides(pairs, keep=()).select(F.explode(F.split("text", RAW_SPLIT)).alias("raw"))
    counted = tokens.filter("raw != ''").groupBy("raw").agg(F.count("*").alias("n"))
    folded = counted.select(F.explode(F.split(nfkc_fold("raw"), " ")).alias("word"), "n")
    return folded.filter("word != ''").groupBy("word").agg(F.sum("n").alias("freq"))


def folded_words(pairs: DataFrame) -> DataFrame:
    """Each distinct raw word with its folded form."""
    tokens = stack_sides(pairs, keep=()).select(F.explode(F.split("text", RAW_SPLIT)).alias("raw"))
    return tokens.filter("raw != ''").distinct().select("raw", nfkc_fold("raw").alias("folded"))


def char_coverage(words: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """Characters by frequency; ``kept`` is true until their share reaches ``coverage``.

    Characters are counted on distinct words; the window runs over the character table
    alone, which Unicode bounds.
    """
    chars = (
        words.select(F.explode(F.split(F.concat(F.lit(WORD_MARK), "word"), "")).alias("char"), "freq")
        .groupBy("char")
        .agg(F.sum("freq").alias("freq"))
    )
    by_freq = Window.orderBy(F.desc("freq"), "char")
    before = F.coalesce(
        F.sum("freq").over(by_freq.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    total = F.sum("freq").over(Window.partitionBy())
    return chars.select(
        "char",
        "freq",
        F.row_number().over(by_freq).alias("char_rank"),
        (before < F.lit(coverage) * total).alias("kept"),
    )


def symbols(segmented: Column) -> Column:
    """Symbols of a wrapped word."""
    return F.split(F.substring(segmented, F.lit(2), F.length(segmented) - 2), _CLOSE + _OPEN)


def segment_chars(words: DataFrame, alphabet: Sequence[str]) -> DataFrame:
    """Start of learning: each word as wrapped characters; uncovered ones become unknown."""
    known = F.regexp_replace(F.concat(F.lit(WORD_MARK), "word"), f"[^{_char_class(alphabet)}]", _UNKNOWN)
    return words.select(F.regexp_replace(known, "(?s)(.)", f"{_OPEN}$1{_CLOSE}").alias("seg"), "freq")


def _char_class(chars: Sequence[str]) -> str:
    """Regex class of ``chars`` as code-point ranges."""
    spans: list[list[int]] = []
    for point in sorted(map(ord, chars)):
        if spans and spans[-1][1] == point - 1:
            spans[-1][1] = point
        else:
            spans.append([point, point])
    return "".join(rf"\x{{{lo:x}}}-\x{{{hi:x}}}" for lo, hi in spans)


def _pair_rows(segmented: DataFrame, protected: Sequence[str]) -> DataFrame:
    sym = segmented.select(symbols(F.col("seg")).alias("s"), "freq")
    pairs = sym.select(
        F.inline(
            F.arrays_zip(
                F.slice("s", F.lit(1), F.size("s") - 1).alias("left"),
                F.slice("s", F.lit(2), F.size("s") - 1).alias("right"),
            )
        ),
        "freq",
    )
    fixed = [*protected, _UNKNOWN]
    return pairs.filter(~(F.col("left").isin(fixed) | F.col("right").isin(fixed)))


def pair_counts(segmented: DataFrame, protected: Sequence[str] = PROTECTED) -> DataFrame:
    """Adjacent symbol pairs weighted by word frequency; protected symbols never pair."""
    return _pair_rows(segmented, protected).groupBy("left", "right").agg(F.sum("freq").alias("freq"))


@dataclass
class SubwordModel:
    """Merges in rank order and the vocabulary. Both are bounded by the vocabulary size."""

    merges: list[tuple[int, str, str, int]] = field(default_factory=list)
    vocab: list[tuple[int, str, str]] = field(default_factory=list)
    rounds: int = 0

    def merges_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.merges, MERGES_SCHEMA)

    def vocab_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.vocab, VOCAB_SCHEMA)

    def save(self, spark: SparkSession, path: str) -> None:
        self.merges_frame(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/merges")
        self.vocab_frame(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/vocab")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> SubwordModel:
        merges = spark.read.schema(MERGES_SCHEMA).parquet(f"{path}/merges").orderBy("rank")
        vocab = spark.read.schema(VOCAB_SCHEMA).parquet(f"{path}/vocab").orderBy("id")
        return cls([tuple(r) for r in merges.collect()], [tuple(r) for r in vocab.collect()])


def word_symbols(words: DataFrame, alphabet: Sequence[str]) -> DataFrame:
    """Start of learning: ``ids, freq``, each word as places in ``alphabet``; characters outside it never pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {c: i for i, c in enumerate(alphabet)}
        for batch in batches:
            ids = [[place.get(c, merging.NEVER) for c in WORD_MARK + w] for w in batch.column("word").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.list_(pa.int32())), batch.column("freq")], names=["ids", "freq"])

    return words.select("word", F.col("freq").cast("long")).mapInArrow(run, merging.SHARD_SCHEMA)


def learn_bpe(
    words: DataFrame, vocab_size: int = VOCAB_SIZE, protected: Sequence[str] = PROTECTED, coverage: float = COVERAGE,
    on_round: Callable[[int, int], None] | None = None, **limits: int,
) -> SubwordModel:
    """Learn merges from a (word, freq) table until the vocabulary is full.

    The result is that of merging the most frequent pair, one at a time; ties go to the smaller left, then right
    symbol. :func:`merging.learn` tells how, and takes ``limits``.
    """
    spark = words.sparkSession
    words, path = store(words, "words")
    # Unicode bounds the alphabet; the rest of the driver's state is the vocabulary and a bounded number of pairs.
    kept = char_coverage(words, coverage).filter("kept").orderBy("char_rank")
    chars = [r.char for r in kept.select("char").collect()]
    vocab = _seed_vocab(protected, chars)
    if len(vocab) > vocab_size:
        raise ValueError(f"vocab_size {vocab_size} cannot hold {len(vocab)} symbols")
    pieces = {piece for _, piece, _ in vocab}
    alphabet = sorted({*chars, *protected, WORD_MARK})
    model = SubwordModel()
    merges, model.rounds = merging.learn(
        word_symbols(words, alphabet), alphabet, protected, vocab_size - len(vocab), on_round, **limits
    )
    discard(spark, path)
    for rank, (left, right, freq) in enumerate(merges):
        model.merges.append((rank, left, right, freq))
        if left + right not in pieces:
            pieces.add(left + right)
            vocab.append((len(vocab), left + right, "merge"))
    model.vocab = vocab
    return model


def _seed_vocab(protected: Sequence[str], chars: Sequence[str]) -> list[tuple[int, str, str]]:
    rows = [(i, name, "special") for i, name in SPECIALS]
    rows += [(len(rows) + i, p, "protected") for i, p in enumerate(protected)]
    plain = [c for c in chars if c not in protected]
    return rows + [(len(rows) + i, c, "char") for i, c in enumerate(plain)]


def vocab_report(model: SubwordModel, words: DataFrame) -> DataFrame:
    """Vocabulary size against the word-level one, and the protected symbols' places."""
    vocab = model.vocab_frame(words.sparkSession)
    sizes = vocab.agg(
        F.count("*").alias("n_pieces"),
        F.count_if((F.col("kind") == "protected") & (F.col("id") > EOS)).alias("n_protected"),
    )
    n_words = words.agg(F.count("*")).scalar()
    return sizes.select(
        "n_pieces",
        "n_protected",
        n_words.alias("n_words"),
        (n_words - F.col("n_pieces")).alias("reduction"),
    )
