"""Benchmark decontamination by spaced-seed hashing with substitution-tolerant verification."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinline.llm.tokens import slices
from twinline.llm.wordhash import mix, words_of

# Word places that a seed compares (1) or ignores (0), by the least match that they are complete for: every
# run with four fifths equal and that many equal words holds one of the seeds. A longer run has a part
# of 10 to 19 words with four fifths equal, so 2 changes in 10 and 3 in 15 words are the hardest (tested at all places).
MASKS = {
    8: ("1101111", "111010011", "1100010111", "1111101", "1110111", "101001111"),
    4: ("1111", "10111", "11011", "11101"),
    1: ("1",),
}
MIN_MATCHED = 13  # words, or ``MIN_SHARE`` of a shorter item
MIN_SHARE = 0.8  # of the overlap's words are equal
MIN_ITEM_WORDS = 8  # an item with fewer is in any text; see :func:`short_items`
BLOCK_BYTES = 8 << 20  # of benchmark text sent to the tasks at once
_BITS = 22

HITS = T.ArrayType(
    T.StructType(
        [
            T.StructField("item_id", T.LongType()),
            T.StructField("matched", T.IntegerType()),
            T.StructField("first_word", T.IntegerType()),
            T.StructField("end_word", T.IntegerType()),
        ]
    )
)
_ARROW_HITS = pa.list_(
    pa.struct([("item_id", pa.int64()), ("matched", pa.int32()), ("first_word", pa.int32()), ("end_word", pa.int32())])
)


def seed_hashes(words: np.ndarray, mask: str) -> np.ndarray:
    """A hash at each place where the whole mask fits; it depends on the mask's words only."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for k, bit in enumerate(mask):
        if bit == "1":
            h += words[k : k + n] * np.uint64((0x9E3779B97F4A7C15 * (2 * k + 1)) & (2**64 - 1))
    return mix(h)


def best_overlap(equal: np.ndarray, share: Fraction) -> tuple[int, int, int]:
    """Of a diagonal, the run with most matches that are at least ``share`` of it: start, end, matches.

    Of several the shortest, then the first. No run is lost: each start is taken to its last end.
    """
    starts = np.flatnonzero(equal)
    if not len(starts):
        return 0, 0, 0
    place = np.arange(len(equal) + 1)
    matches = np.concatenate(([0], np.cumsum(equal)))
    # A run is good if this is no lower at its end than at its start.
    height = share.denominator * matches - share.numerator * place
    later = np.maximum.accumulate(height[::-1])[::-1]
    ends = np.searchsorted(-later, -height[starts], "right") - 1
    ends = np.maximum.accumulate(np.concatenate(([0], np.where(equal, place[1:], 0))))[ends]
    matched = matches[ends] - matches[starts]
    at = np.lexsort((starts, ends - starts, -matched))[0]
    return int(starts[at]), int(ends[at]), int(matched[at])


def least_match(n: int, share: Fraction, least: int) -> int:
    """Equal words that an overlap with an item of ``n`` words needs."""
    return min(least, -(-n * share.numerator // share.denominator))


class Benchmark:
    """A bounded block of benchmark items: their words, and a sorted table of their seeds."""

    def __init__(self, ids: list[int], texts: list[str], share: Fraction, least: int):
        found = words_of(pa.array(texts, pa.string()))
        self.ids, self.firsts, self.words = ids, found.firsts, found.hashes
        self.share = share
        self.least = [least_match(int(n), share, least) for n in np.diff(self.firsts)]
        # Below four fifths no longer seed is complete.
        kinds = [max(k for k in MASKS if k <= max(n, 1)) if share >= Fraction(4, 5) else 1 for n in self.least]
        self.seeds = []
        for kind, masks in MASKS.items():
            for mask in masks:
                at = self._places(len(mask), [k == kind for k in kinds])
                if not len(at):
                    continue
                keys = seed_hashes(self.words, mask)[at]
                order = np.argsort(keys, kind="stable")
                bits = np.zeros(1 << _BITS, bool)
                bits[keys & np.uint64((1 << _BITS) - 1)] = True
                self.seeds.append((mask, keys[order], at[order], bits))

    def _places(self, span: int, wanted: list[bool]) -> np.ndarray:
        spans = zip(self.firsts[:-1], self.firsts[1:], wanted)
        runs = [np.arange(a, b - span + 1) for a, b, want in spans if want and b - a >= span]
        return np.concatenate(runs) if runs else np.empty(0, np.int64)

    def candidates(self, words: np.ndarray) -> np.ndarray:
        """Distinct (place in ``words`` minus place in the benchmark) pairs with an item: rows (item, delta)."""
        pairs = []
        for mask, keys, at, bits in self.seeds:
            h = seed_hashes(words, mask)
            near = np.flatnonzero(bits[h & np.uint64((1 << _BITS) - 1)])
            lo, hi = np.searchsorted(keys, h[near], "left"), np.searchsorted(keys, h[near], "right")
            n = hi - lo
            if not n.sum():
                continue
            pick = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
            pairs.append((np.repeat(near, n), at[pick]))
        if not pairs:
            return np.empty((0, 2), np.int64)
        place = np.concatenate([p for p, _ in pairs])
        own = np.concatenate([a for _, a in pairs])
        item = np.searchsorted(self.firsts, own, "right") - 1
        return np.unique(np.column_stack([item, place - own]), axis=0)


def _verify(bench: Benchmark, words: np.ndarray, firsts: np.ndarray) -> dict[int, list[dict]]:
    """Per text the verified overlaps, the largest of each item."""
    out: dict[int, dict[int, dict]] = {}
    done = set()
    for item, delta in bench.candidates(words).tolist():
        a, b = bench.firsts[item], bench.firsts[item + 1]
        # The diagonal may touch several texts: each gets its own part.
        lo, hi = max(a + delta, 0), min(b + delta, len(words))
        d0, d1 = np.searchsorted(firsts, lo, "right") - 1, np.searchsorted(firsts, hi - 1, "right") - 1
        for d in range(d0, d1 + 1):
            x, y = max(lo, firsts[d]), min(hi, firsts[d + 1])
            if y <= x or (item, delta, d) in done:
                continue
            done.add((item, delta, d))
            start, end, matched = best_overlap(words[x:y] == bench.words[x - delta : y - delta], bench.share)
            if matched >= bench.least[item]:
                hit = {
                    "item_id": bench.ids[item], "matched": matched,
                    "first_word": int(x - firsts[d] + start), "end_word": int(x - firsts[d] + end),
                }
                old = out.setdefault(int(d), {}).get(item)
                if old is None or old["matched"] < matched:
                    out[int(d)][item] = hit
    return {d: [hits[i] for i in sorted(hits)] for d, hits in out.items()}


def _word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != ""))


def short_items(benchmark: DataFrame, text: str = "text", min_words: int = MIN_ITEM_WORDS) -> DataFrame:
    """The items that are not searched for: without text, or too short to tell a leak from chance."""
    return benchmark.filter(F.coalesce(_word_count(F.col(text)), F.lit(0)) < min_words)


def benchmark_blocks(
    benchmark: DataFrame, item_id: str, text: str, min_share: float, min_matched: int, min_words: int
) -> Iterator[Benchmark]:
    """The query set in blocks of about ``BLOCK_BYTES`` of text, each collected on its own."""
    rows = benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(text).alias("t")).filter(_word_count(F.col("t")) >= min_words)
    size = rows.agg(F.sum(F.octet_length("t")).alias("n")).first()["n"] or 0
    blocks = -(-size // BLOCK_BYTES)
    for k in range(blocks):
        part = rows.filter(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k).orderBy("i", "t").collect()
        yield Benchmark([r["i"] for r in part], [r["t"] for r in part], Fraction(str(min_share)), min_matched)


def mark_overlaps(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    name: str = "overlaps", min_share: float = MIN_SHARE, min_matched: int = MIN_MATCHED, min_words: int = MIN_ITEM_WORDS,
) -> DataFrame:
    """``docs`` with ``name``: the benchmark items that each whole text overlaps, with the words' places.

    A seed that agrees gives a diagonal; on it the run of words with most equal, at least ``min_share`` of it,
    counts if it has ``min_matched`` equal words, or ``min_share`` of a shorter item. Null texts and an empty
    benchmark give empty arrays; items of fewer than ``min_words`` words are left out (:func:`short_items` lists them), those without
    an id are searched like others and give hits with a null id; every other column and every
    row passes. Nothing is shuffled: each block of the benchmark is one pass over the rows.
    """
    if name in docs.columns:
        raise ValueError(f"column {name} exists")
    rows = docs.withColumn(name, F.array().cast(HITS))
    schema = T.StructType([*docs.schema.fields, T.StructField(name, HITS)])
    at_text, at_hits = docs.columns.index(text), len(docs.columns)
    for bench in benchmark_blocks(benchmark, item_id, item_text, min_share, min_matched, min_words):

        def run(batches: Iterator[pa.RecordBatch], bench=bench) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for s in slices(batch, text):
                    words = words_of(s.column(at_text))
                    hits = _verify(bench, words.hashes, words.firsts)
                    column = s.column(at_hits)
                    if hits:
                        column = pa.array(
                            [old + hits.get(i, []) for i, old in enumerate(column.to_pylist())], _ARROW_HITS
                        )
                    yield pa.RecordBatch.from_arrays([*s.columns[:at_hits], column], names=s.schema.names)

        rows = rows.mapInArrow(run, schema)
    return rows
