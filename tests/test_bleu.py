from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest

from tests.test_clean_split import plan_of
from twinline.operators import bleu
from pyspark.sql import functions as F

SEG = "seg_id long, hypothesis string, reference string"


def tokens_13a(line: str) -> list[str]:
    line = line.replace("<skipped>", "").replace("-\n", "").replace("\n", " ")
    for entity, char in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        line = line.replace(entity, char)
    line = f" {line} "
    line = "".join(f" {c} " if c.isascii() and not c.isalnum() and c not in " \t\r'-.,\x0b\x0c" and c.isprintable() else c for c in line)
    line = re.sub(r"(\D)([.,])", r"\1 \2 ", line, flags=re.A)
    line = re.sub(r"([.,])(\D)", r" \1 \2", line, flags=re.A)
    line = re.sub(r"(\d)(-)", r"\1 \2 ", line, flags=re.A)
    return line.split()


def brute_bleu(rows) -> tuple[float, float]:
    match, total = [0] * 4, [0] * 4
    hyp_len = ref_len = 0
    for _, hyp, ref in rows:
        h, r = tokens_13a(hyp), tokens_13a(ref)
        hyp_len += len(h)
        ref_len += len(r)
        for n in range(1, 5):
            grams = lambda t: Counter(tuple(t[i : i + n]) for i in range(len(t) - n + 1))
            hg, rg = grams(h), grams(r)
            match[n - 1] += sum((hg & rg).values())
            total[n - 1] += sum(hg.values())
    if not any(match) or 0 in total:
        return 0.0, 0.0
    halves, logs = 1.0, 0.0
    for m, t in zip(match, total):
        if m == 0:
            halves /= 2
        logs += math.log((m or halves) / t)
    penalty = 1.0 if hyp_len >= ref_len else math.exp(1 - ref_len / hyp_len)
    return 100 * penalty * math.exp(logs / 4), penalty


def test_tokens(spark):
    texts = ["It's 3.5, ok.", "a-b 10-20 (x)", "Hello, world!\nend-\ning", "&quot;A&quot; &lt;b", "1,000.5.", "café x/y_z"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = df.select("i", bleu.bleu_tokenize(F.col("t")).alias("x")).orderBy("i").collect()
    assert [r.x for r in got] == [tokens_13a(t) for t in texts]
    assert got[0].x == ["It's", "3.5", ",", "ok", "."]


def score(spark, rows):
    return bleu.bleu_corpus(spark.createDataFrame(rows, SEG)).first()


@pytest.mark.parametrize("seed", range(4))
def test_score_against_brute_force(spark, seed):
    rng = random.Random(seed)
    words = "the cat sat on a mat , dog 3.5 10-20 .".split()
    line = lambda: " ".join(rng.choices(words, k=rng.randint(0, 12)))
    rows = [(i, line(), line()) for i in range(40)]
    expected, penalty = brute_bleu(rows)
    got = score(spark, rows)
    assert abs(got.bleu - expected) < 1e-9 and abs(got.brevity_penalty - penalty) < 1e-9


def test_edges(spark):
    same = [(1, "a b c d e", "a b c d e")]
    assert abs(score(spark, same).bleu - 100) < 1e-9 and score(spark, same).band == "30+"
    assert score(spark, [(1, "x y z w", "a b c d")]).bleu == 0.0
    smoothed = [(1, "a b x y z", "a b c d e")]  # no 3-gram or 4-gram matches
    assert abs(score(spark, smoothed).bleu - brute_bleu(smoothed)[0]) < 1e-9
    assert score(spark, [(1, "a b c", "a b c")]).bleu == 0.0  # no 4-gram at all
    empty = score(spark, [(1, "", "a b c d")])
    assert (empty.bleu, empty.hyp_len, empty.ref_len, empty.band) == (0.0, 0, 4, "0-10")


def test_bands(spark):
    df = spark.createDataFrame([(0.0,), (9.99,), (10.0,), (20.0,), (29.9,), (30.0,)], "s double")
    got = [r.b for r in df.select(bleu.score_band(F.col("s")).alias("b")).collect()]
    assert got == ["0-10", "0-10", "10-20", "20-30", "20-30", "30+"]


def test_segments_match_by_id_and_grams_stay_put(spark):
    hyps = spark.createDataFrame([(2, "b b"), (1, "a")], "seg_id long, hypothesis string")
    refs = spark.createDataFrame([(1, "a", "c1"), (2, "b", "c2")], "seg_id long, reference string, category string")
    pairs = bleu.pair_segments(hyps, refs)
    counts = {(r.seg_id, r.gram): (r.hyp_count, r.ref_count) for r in bleu.ngram_counts(pairs).collect()}
    assert counts == {(1, "a"): (1, 1), (2, "b"): (2, 1), (2, "b b"): (1, 0)}
    plan = plan_of(bleu.clipped_matches(pairs))
    assert not [line for line in plan.splitlines() if "Exchange" in line and "gram" in line]


def test_counting_holds_few_segments_at_a_time(spark, monkeypatch):
    """Segments that come twice, null texts and rows in slices of few tokens; most tokens handed on at a time are bounded."""
    rng = random.Random(5)
    line = lambda: " ".join(rng.choices("a b c d".split(), k=rng.randint(0, 9)))
    rows = [(rng.choice([None, *range(40)]), line() or None, line() or None) for _ in range(120)]
    want = {}
    for seg, *texts in rows:
        for side, text in enumerate(texts):
            t = tokens_13a(text or "")
            for n in range(1, 5):
                for i in range(len(t) - n + 1):
                    want.setdefault((seg, n, " ".join(t[i : i + n])), [0, 0])[side] += 1
    got = bleu.ngram_counts(spark.createDataFrame(rows, SEG).repartition(3))
    assert {(r.seg_id, r.n, r.gram): [r.hyp_count, r.ref_count] for r in got.collect()} == want and got.count() == len(want)

    monkeypatch.setattr(bleu, "SLICE_TOKENS", 8)
    batch = bleu.pa.RecordBatch.from_pylist([{"hypothesis": ["a"] * k, "reference": ["a"] * 3} for k in (9, 0, 1, 2, 3, 0)])
    parts = list(bleu._slices(batch, ("hypothesis", "reference")))
    assert bleu.pa.Table.from_batches(parts).to_pylist() == batch.to_pylist() and [p.num_rows for p in parts] == [1, 2, 1, 1, 1]
    table = bleu.pa.Table.from_pylist([{"place": 0, "hypothesis": ["a", "b", "a", "b"], "reference": ["a", "b"]}])
    counts = [(r["n"], r["gram"], r["hyp_count"], r["ref_count"]) for b in bleu._counted(table, 2) for r in b.to_pylist()]
    assert sorted(counts) == [(1, "a", 2, 1), (1, "b", 2, 1), (2, "a b", 2, 1), (2, "b a", 1, 0)]


def test_no_row_of_an_ngram_is_aggregated_by_spark(spark):
    pairs = bleu.pair_segments(
        spark.createDataFrame([(1, "a")], "seg_id long, hypothesis string"), spark.createDataFrame([(1, "a")], "seg_id long, reference string")
    )
    plan = plan_of(bleu.ngram_counts(pairs))
    assert "Aggregate" not in plan and plan.count("Exchange hashpartitioning") == 2
