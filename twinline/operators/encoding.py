"""Text to subword ids and back."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinline.functions.sequences import BOS, EOS, PAD, UNK, shared_ids, unknown_count
from twinline.functions.text import fold
from twinline.operators.subword import RAW_SPLIT, UNKNOWN_TEXT, WORD_MARK, SubwordModel

# Words remembered by a Python worker; a bound on memory, not on what is encoded.
CACHED_WORDS = 1_000_000


def _word_encoder(model: SubwordModel) -> Callable[[str], list[int]]:
    """Function from a folded word to ids: the learned merges in their order.

    The symbols are a linked list, and a heap holds the places where a merge is due. So a word of n characters takes
    n log n steps, however many merges it needs.
    """
    ids = {piece: i for i, piece, kind in model.vocab if kind != "special"}
    ranks: dict[tuple[str, str], list[int]] = {}
    for rank, left, right, _ in model.merges:
        ranks.setdefault((left, right), []).append(rank)
    pairs = {rank: (left, right) for rank, left, right, _ in model.merges}

    def encode_word(word: str) -> list[int]:
        syms: list[str | None] = [c if c in ids else "" for c in WORD_MARK + word]
        n = len(syms)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        due = [(later[0], i) for i in range(n - 1) if (later := ranks.get((syms[i], syms[i + 1])))]
        heapify(due)

        def expect(i: int, rank: int) -> None:
            # A pair that comes up after its merge has passed waits for a later merge of the same pair.
            later = ranks.get((syms[i], syms[after[i]]), ())
            at = bisect_right(later, rank)
            if at < len(later):
                heappush(due, (later[at], i))

        while due:
            rank, i = heappop(due)
            j = after[i]
            if j >= n or (syms[i], syms[j]) != pairs[rank]:
                continue  # an earlier merge took one of them
            syms[i], syms[j] = syms[i] + syms[j], None
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
                expect(i, rank)
            if before[i] >= 0:
                expect(before[i], rank)
        found = [s for s in syms if s is not None]
        # A run of unknown characters is one unknown token.
        return [ids.get(s, UNK) for i, s in enumerate(found) if s or i == 0 or found[i - 1]]

    return encode_word


class _TextEncoder:
    """Ids of whole text columns; Python sees each distinct word of a batch once."""

    def __init__(self, model: SubwordModel):
        self.word_ids = _word_encoder(model)
        self.known: dict[str, np.ndarray] = {}

    def _raw(self, raw: str) -> np.ndarray:
        found = self.known.get(raw)
        if found is None:
            ids = [i for word in fold(raw).split(" ") if word for i in self.word_ids(word)]
            found = np.array(ids, np.int32)
            if len(self.known) < CACHED_WORDS:
                self.known[raw] = found
        return found

    def __call__(self, column: pa.Array) -> pa.Array:
        words = pc.split_pattern_regex(column.cast(pa.large_string()), RAW_SPLIT)
        coded = words.flatten().dictionary_encode()
        distinct = [self._raw(w) for w in coded.dictionary.to_pylist()]
        if not distinct:
            return pa.array([None if x is None else [] for x in column.to_pylist()], pa.list_(pa.int32()))
        size = np.array([len(x) for x in distinct])
        start = np.cumsum(size) - size
        which = coded.indices.to_numpy()
        n = size[which]
        ends = np.cumsum(n)
        flat = np.concatenate(distinct)[np.repeat(start[which] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        # The words of null texts are none, so their offsets stand still.
        counts = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
        offsets = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(counts)))].astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()), mask=column.is_null())


def encode_pairs(pairs: DataFrame, model: SubwordModel) -> DataFrame:
    """Add ``src_ids`` and ``tgt_ids``.

    Both sides go through Python together, where their text lies: exploding every word to
    a join would shuffle the corpus twice. Each worker encodes a word once and remembers
    it. The model, bounded by its vocabulary, ships with the function.
    """
    ids = T.ArrayType(T.IntegerType())

    @F.arrow_udf(T.StructType().add("src_ids", ids).add("tgt_ids", ids))
    def encode(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        encoder = _TextEncoder(model)
        for src, tgt in batches:
            yield pa.StructArray.from_arrays([encoder(src), encoder(tgt)], names=["src_ids", "tgt_ids"])

    encoded = pairs.withColumn("_ids", encode("src", "tgt"))
    return encoded.select(*pairs.columns, "_ids.src_ids", "_ids.tgt_ids")


def _piece_list(vocab: DataFrame) -> Column:
    # One row of at most vocab_size pieces, evaluated once and shipped with the plan.
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("id", "piece"))), lambda v: v["piece"])
    return vocab.agg(ordered.alias("pieces")).scalar()


def decode_pieces(df: DataFrame, vocab: DataFrame, ids: str, out: str = "pieces") -> DataFrame:
    """Add the piece of each id. ``vocab`` ids run from 0 without gaps."""
    looked_up = df.withColumn("_pieces", _piece_list(vocab))
    pieces = F.transform(F.col(ids), lambda i: F.element_at(F.col("_pieces"), i + 1))
    return looked_up.withColumn(out, pieces).drop("_pieces")


def decode_text(df: DataFrame, vocab: DataFrame, ids: str, out: str = "decoded") -> DataFrame:
    """Add the text of an id list. Padding and sentence marks show nothing."""
    named = {i: "" for i in (PAD, BOS, EOS)} | {UNK: UNKNOWN_TEXT}
    shown = F.col("piece")
    for i, text in named.items():
        shown = F.when(F.col("id") == i, text).otherwise(shown)
    readable = vocab.withColumn("piece", shown)
    joined = decode_pieces(df, readable, ids, "_shown")
    text = F.replace(F.array_join("_shown", ""), F.lit(WORD_MARK), F.lit(" "))
    return joined.withColumn(out, F.regexp_replace(text, "^ ", "")).drop("_shown")


def unk_rate(encoded: DataFrame) -> DataFrame:
    """Unknown tokens and all tokens by side."""
    sides = F.array(
        *[F.struct(F.lit(s).alias("side"), F.col(f"{s}_ids").alias("ids")) for s in ("src", "tgt")]
    )
    return (
        encoded.select(F.inline(sides))
        .groupBy("side")
        .agg(F.sum(unknown_count(F.col("ids"))).alias("n_unk"), F.sum(F.size("ids")).alias("n_tokens"))
    )


def shared_pieces(encoded: DataFrame, vocab: DataFrame) -> DataFrame:
    """Pieces that both sides of a pair have in common."""
    both = encoded.withColumn("shared_ids", shared_ids(F.col("src_ids"), F.col("tgt_ids")))
    return decode_pieces(both, vocab, "shared_ids", "shared")
