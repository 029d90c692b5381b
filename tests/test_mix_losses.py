from __future__ import annotations

import hashlib
import random
from collections import Counter

from pyspark.sql import functions as F

from tests.test_clean_split import plan_of
from twinline.functions import sequences as Q
from twinline.operators import losses, mix

WEIGHTS = {"big": 1, "small": 20, "off": 0}


def sources(spark):
    rows = [("big", i) for i in range(300)] + [("small", i) for i in range(7)] + [("off", 1), ("other", 2)]
    return spark.createDataFrame(rows, "source string, ord long")


def test_mix_repeats_by_weight(spark):
    got = Counter((r.source, r.ord) for r in mix.weighted_mix(sources(spark), WEIGHTS).collect())
    assert got == Counter({("big", i): 1 for i in range(300)}) + Counter({("small", i): 20 for i in range(7)})
    report = {r.source: (r.n_pairs, r.n_samples) for r in mix.mix_report(sources(spark), WEIGHTS).collect()}
    assert report == {"big": (300, 300), "small": (7, 140), "off": (1, 0), "other": (1, 0), "(total)": (309, 440)}


def brute_order(rows, seed):
    key = lambda r: hashlib.md5(f"{seed}|{r[0]}|{r[1]}|{r[2]}".encode()).hexdigest()
    return sorted(rows, key=key)


def test_shuffle_and_batches_against_brute_force(spark):
    mixed = mix.weighted_mix(sources(spark), WEIGHTS)
    rows = [(r.source, r.ord, r.copy) for r in mixed.collect()]
    order = brute_order(rows, 7)
    shuffled = [(r.source, r.ord, r.copy) for r in mix.shuffled_mix(mixed, 7).collect()]
    assert shuffled == order and shuffled != brute_order(rows, 8)
    for parts, digits in ((1, 1), (17, 4)):
        df = mixed.repartition(parts)
        for drop in (True, False):
            got = mix.assign_batches(df, 32, seed=7, drop_last=drop, bucket_hex=digits)
            n = len(order) // 32 * 32 if drop else len(order)
            expected = {row: (i // 32, i % 32) for i, row in enumerate(order[:n])}
            assert {(r.source, r.ord, r.copy): (r.batch_id, r.pos) for r in got.collect()} == expected


def test_ordered_batches_over_sparse_positions(spark):
    ords = random.Random(2).sample(range(-(10**9), 10**9), 500)
    df = spark.createDataFrame([(o,) for o in ords], "ord long")
    got = mix.assign_batches(df, 128, order="ord", drop_last=False, bucket_span=1000).orderBy("ord").collect()
    assert [(r.batch_id, r.pos) for r in got] == [(i // 128, i % 128) for i in range(500)]


def test_batches_use_no_single_task(spark):
    mixed = mix.weighted_mix(sources(spark), WEIGHTS)
    plan = plan_of(mix.assign_batches(mixed, 32, seed=7, drop_last=False))
    lines = plan.splitlines()
    below = [lines[i + 1] for i, line in enumerate(lines) if "SinglePartition" in line]
    # One task sees totals of bucket chunks, never rows.
    assert all("HashAggregate(keys=" in line and "_chunk" in line for line in below)


def test_pack_shift_and_mask(spark):
    df = spark.createDataFrame([(n, list(range(10, 10 + n))) for n in (0, 30, 31, 3)], "n int, ids array<int>")
    packed = df.withColumn("p", Q.pack(F.col("ids")))
    got = {r.n: r for r in packed.select("n", "p", Q.decoder_input(F.col("p")).alias("i"), Q.decoder_target(F.col("p")).alias("o"), Q.padding_mask(F.col("p")).alias("m")).collect()}
    assert got[0].p == [2, 3] + [0] * 30
    assert got[30].p == [2, *range(10, 40), 3] and not any(got[30].m)
    assert got[31].p == [2, *range(10, 40), 3]
    for n, r in got.items():
        assert len(r.p) == 32 and r.i == r.p[:-1] and r.o == r.p[1:] and r.m == [x == 0 for x in r.p]


LOG = "run string, epoch int, step long, batch long, loss double"


def random_log(n=3000):
    rng = random.Random(4)
    steps = rng.sample(range(1, 20 * n), n)
    return [("a" if rng.random() < 0.9 else None, rng.randint(1, 3), s, s // 50, rng.random()) for s in steps]


def test_running_loss_against_brute_force(spark):
    log = random_log()
    expected, sums = {}, {}
    for run, epoch, step, _, loss in sorted(log, key=lambda r: r[2]):
        total, n = sums.get((run, epoch), (0.0, 0))
        sums[run, epoch] = total + loss, n + 1
        if step % 10 == 0:
            expected[run, epoch, step] = (loss, (total + loss) / (n + 1))
    df = spark.createDataFrame(log, LOG).repartition(17)
    got = {(r.run, r.epoch, r.step): (r.loss, r.running_avg) for r in losses.running_loss(df, 10, span=64).collect()}
    assert got.keys() == expected.keys() and expected
    assert all(got[k][0] == v[0] and abs(got[k][1] - v[1]) < 1e-9 for k, v in expected.items())


def test_validation_mean_weighs_batches_equally(spark):
    log = spark.createDataFrame([("r", 1, 1, 0, 1.0), ("r", 1, 2, 0, 1.0), ("r", 1, 3, 0, 1.0), ("r", 1, 4, 1, 3.0)], LOG)
    assert losses.val_loss(log).first().avg_val_loss == 2.0
    assert losses.epoch_loss(log).first().avg_loss == 1.5


def test_best_and_latest_checkpoint(spark):
    rows = [("r", 1, 2.0), ("r", 2, 1.0), ("r", 3, 1.0), ("r", 4, float("nan")), ("r", 5, None), ("s", 1, float("nan"))]
    epochs = spark.createDataFrame(rows, "run string, epoch int, loss double")
    first, last = (losses.best_checkpoint(epochs, "loss", keep_last_tie=t).collect() for t in (False, True))
    assert [(r.run, r.best_epoch, r.best_loss) for r in first] == [("r", 2, 1.0)]
    assert [(r.run, r.best_epoch, r.best_loss) for r in last] == [("r", 3, 1.0)]
    assert {(r.run, r.resume_epoch) for r in losses.latest_checkpoint(epochs, 4).collect()} == {("r", 4), ("s", 1)}
