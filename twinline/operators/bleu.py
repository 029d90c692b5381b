"""Corpus BLEU over tables of hypotheses and references (public mteval-13a tokens, n = 1..4)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinline.functions.text import words

MAX_ORDER = 4
SLICE_TOKENS = 1 << 18  # counted at a time, which bounds a worker's memory whatever a batch holds

# Fixed values of the public 13a tokenization: literal replacements, then patterns.
LITERALS_13A = (
    ("<skipped>", ""),
    ("-\n", ""),
    ("\n", " "),
    ("&quot;", '"'),
    ("&amp;", "&"),
    ("&lt;", "<"),
    ("&gt;", ">"),
)
PATTERNS_13A = (
    (r"([{-~\[-` -&(-+:-@/])", r" $1 "),
    (r"([^0-9])([.,])", r"$1 $2 "),
    (r"([.,])([^0-9])", r" $1 $2"),
    (r"([0-9])(-)", r"$1 $2 "),
)

# Lower bounds of the score bands.
BANDS = ((30, "30+"), (20, "20-30"), (10, "10-20"), (0, "0-10"))


def bleu_tokenize(text: Column) -> Column:
    """13a tokens of a text."""
    for found, put in LITERALS_13A:
        text = F.replace(text, F.lit(found), F.lit(put))
    text = F.concat(F.lit(" "), text, F.lit(" "))
    for pattern, put in PATTERNS_13A:
        text = F.regexp_replace(text, pattern, put)
    return words(text)


def pair_segments(hyps: DataFrame, refs: DataFrame) -> DataFrame:
    """Hypothesis and reference of each segment, matched by ``seg_id``, not by position.

    A merge join leaves the segments hash-partitioned by ``seg_id``. The n-gram counts
    build on that, so n-grams, several times the size of the text, are never shuffled.
    """
    other = refs.drop(*[c for c in refs.columns if c in hyps.columns and c != "seg_id"])
    return hyps.hint("merge").join(other, "seg_id")


def _counted(rows: pa.Table, max_order: int) -> Iterator[pa.RecordBatch]:
    """``place, n, gram, hyp_count, ref_count`` of rows whose segments are told apart by ``place``."""
    sides = []
    for c in ("hypothesis", "reference"):
        lists = rows[c].combine_chunks()
        count = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        tokens = lists.flatten().cast(pa.large_string())
        sides.append([np.repeat(np.arange(len(count)), count), tokens, tokens])
    place = rows["place"].to_numpy()
    for n in range(1, max_order + 1):
        parts = []
        for in_hyp, side in ((1, sides[0]), (0, sides[1])):
            row, tokens, grams = side
            if n > 1:
                side[2] = grams = pc.binary_join_element_wise(grams[:-1], tokens[n - 1 :], pa.scalar(" ", pa.large_string()))
            inside = row[: len(grams)] == row[len(row) - len(grams) :]
            found = place[row[: len(grams)][inside]]
            hyp = pa.array(np.full(len(found), in_hyp))
            ref = pa.array(np.full(len(found), 1 - in_hyp))
            parts.append(pa.table([pa.array(found), grams.filter(pa.array(inside)), hyp, ref], names=["place", "gram", "hyp", "ref"]))
        sums = pa.concat_tables(parts).group_by(["place", "gram"]).aggregate([("hyp", "sum"), ("ref", "sum")]).combine_chunks()
        columns = [sums["place"], pa.array(np.full(len(sums), n, np.int32)), sums["gram"].cast(pa.string()), sums["hyp_sum"], sums["ref_sum"]]
        yield from pa.table(columns, names=["place", "n", "gram", "hyp_count", "ref_count"]).to_batches(SLICE_TOKENS)


def ngram_counts(segments: DataFrame, max_order: int = MAX_ORDER) -> DataFrame:
    """Occurrences of each n-gram in the hypothesis and in the reference of its segment.

    The rows of a segment come one after another, so a task holds the n-grams of some segments at a time, never all of its
    own. Numbering them asks for no more than the order that :func:`pair_segments` leaves.
    """
    in_segment = Window.partitionBy("seg_id").orderBy("seg_id")
    numbered = segments.select("seg_id", "hypothesis", "reference", F.row_number().over(in_segment).alias("nth"))
    tokens = numbered.select("seg_id", "nth", *[bleu_tokenize(F.col(c)).alias(c) for c in ("hypothesis", "reference")])

    def counted(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held)
        first = rows["nth"].to_numpy() == 1
        ids = rows["seg_id"].filter(pa.array(first)).combine_chunks()
        for sums in _counted(rows.append_column("place", pa.array(np.cumsum(first) - 1)), max_order):
            if sums.num_rows:
                yield pa.RecordBatch.from_arrays(
                    [ids.take(sums["place"]), *sums.columns[1:]], names=["seg_id", "n", "gram", "hyp_count", "ref_count"]
                )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # of the last segment, which may go on
        for batch in (part for whole in batches for part in _slices(whole, ("hypothesis", "reference"))):
            starts = np.flatnonzero(batch["nth"].to_numpy() == 1)
            if len(starts):
                if held or starts[-1]:
                    yield from counted([*held, batch.slice(0, starts[-1])])
                held = []
            held.append(batch.slice(starts[-1] if len(starts) else 0))
        if held:
            yield from counted(held)

    kind = segments.schema["seg_id"].dataType.simpleString()
    return tokens.mapInArrow(run, f"seg_id {kind}, n int, gram string, hyp_count long, ref_count long")


_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M2
    return h ^ (h >> np.uint64(31))


def gram_keys(lists: pa.Array, max_order: int) -> list[np.ndarray]:
    """Of each order, a key of every n-gram of every token-hash list; equal n-grams of one list have equal keys."""
    count = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    tokens = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    owner = np.repeat(np.arange(1, len(count) + 1, dtype=np.uint64), count)
    keys, gram = [], _mixed(tokens * _M1)
    for n in range(1, max_order + 1):
        if n > 1:
            gram = _mixed(gram[:-1] * _M1 + tokens[n - 1 :]) if len(gram) else gram
        size = len(gram)
        inside = owner[:size] == owner[len(owner) - size :]
        keys.append(_mixed(gram[inside] + owner[:size][inside] * _M1))
    return keys


def _slices(batch: pa.RecordBatch, columns: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """Rows of together at most :data:`SLICE_TOKENS` tokens, or one row."""
    size = sum(pc.fill_null(pc.list_value_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns)
    end, at = np.cumsum(size), 0
    while at < batch.num_rows:
        most = (end[at - 1] if at else 0) + SLICE_TOKENS
        to = max(at + 1, int(np.searchsorted(end, most, "right")))
        yield batch.slice(at, to - at)
        at = to


def clipped_matches(segments: DataFrame, max_order: int = MAX_ORDER) -> DataFrame:
    """Clipped matches and totals by order, summed over the corpus.

    N-grams are 64-bit keys in arrays, counted where the segments lie: no row is made of an n-gram and nothing but a few
    sums a task is shuffled. Null texts have no tokens.
    """
    hashed = lambda c: F.transform(bleu_tokenize(F.col(c)), lambda t: F.xxhash64(t)).alias(c)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((max_order, 3), np.int64)
        for batch in (part for whole in batches for part in _slices(whole, ("hypothesis", "reference"))):
            both = [gram_keys(batch.column(c), max_order) for c in ("hypothesis", "reference")]
            for n, (hyp, ref) in enumerate(zip(*both)):
                (h, in_hyp), (r, in_ref) = (np.unique(x, return_counts=True) for x in (hyp, ref))
                _, i, j = np.intersect1d(h, r, assume_unique=True, return_indices=True)
                sums[n] += np.minimum(in_hyp[i], in_ref[j]).sum(), len(hyp), len(ref)
        columns = [pa.array(np.arange(1, max_order + 1), pa.int32()), *(pa.array(sums[:, k]) for k in range(3))]
        yield pa.RecordBatch.from_arrays(columns, names=["n", "matches", "hyp_total", "ref_total"])

    partial = segments.select(hashed("hypothesis"), hashed("reference")).mapInArrow(
        run, "n int, matches long, hyp_total long, ref_total long"
    )
    return partial.groupBy("n").agg(*[F.sum(c).alias(c) for c in ("matches", "hyp_total", "ref_total")]).filter("hyp_total + ref_total > 0")


def bleu_corpus(segments: DataFrame, max_order: int = MAX_ORDER) -> DataFrame:
    """One row: BLEU from corpus sums, brevity penalty, exponential smoothing, score band."""
    at = lambda n, c: F.coalesce(F.sum(F.when(F.col("n") == n, F.col(c))), F.lit(0))
    sums = clipped_matches(segments, max_order).agg(
        *[at(n, "matches").alias(f"m{n}") for n in range(1, max_order + 1)],
        *[at(n, "hyp_total").alias(f"t{n}") for n in range(1, max_order + 1)],
        at(1, "ref_total").alias("ref_len"),
    )
    log_sum, zeros, cut = F.lit(0.0), F.lit(0), F.lit(False)
    for n in range(1, max_order + 1):
        match, total = F.col(f"m{n}"), F.col(f"t{n}")
        cut = cut | (total == 0)
        # The k-th order without a match counts as 1 / 2^k of a match.
        zeros = zeros + F.when(match == 0, 1).otherwise(0)
        smoothed = F.when(match == 0, F.pow(F.lit(2.0), -zeros)).otherwise(match.cast("double"))
        log_sum = log_sum + F.log(smoothed / F.when(total > 0, total))
    penalty = F.when(
        F.col("t1") < F.col("ref_len"), F.exp(1 - F.col("ref_len") / F.when(F.col("t1") > 0, F.col("t1")))
    ).otherwise(F.lit(1.0))
    no_match = F.array_max(F.array(*[F.col(f"m{n}") for n in range(1, max_order + 1)])) == 0
    score = F.when(no_match | cut, F.lit(0.0)).otherwise(100 * penalty * F.exp(log_sum / max_order))
    scored = sums.select(
        score.alias("bleu"),
        F.coalesce(penalty, F.lit(0.0)).alias("brevity_penalty"),
        F.col("t1").alias("hyp_len"),
        "ref_len",
    )
    return scored.withColumn("band", score_band(F.col("bleu")))


def score_band(score: Column) -> Column:
    band = None
    for low, name in BANDS:
        hit = score >= low
        band = F.when(hit, name) if band is None else band.when(hit, name)
    return band


def eval_table(segments: DataFrame) -> DataFrame:
    """Scored samples in segment order."""
    return segments.select("seg_id", "category", "src", "reference", "hypothesis").orderBy("seg_id")
