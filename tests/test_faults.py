"""Rows that the given tables do not hold: nulls, padded categories, unknown consent, odd CSV headers."""

from __future__ import annotations

import pytest

from twinline import session
from twinline.operators.clean import clean_pairs, cleaning_funnel, dedup_pairs, tag_pairs
from twinline.operators.provenance import consent_filter
from twinline.operators.split import category_report, stratified_split
from twinline.sources.tables import malformed_counts, read_pairs_csv, scan_csv

PAIRS = [(1, "a b c", None), (2, "x y z", None), (3, None, "q r s"), (4, "one two three", "four five six")]


def test_null_sides_are_no_pairs(spark):
    df = spark.createDataFrame(PAIRS, "ord long, src string, tgt string")
    assert [(r.ord, r.n_copies) for r in dedup_pairs(df).collect()] == [(4, 1)]
    assert [r.ord for r in clean_pairs(df).collect()] == [4]
    funnel = {r.rule: r.removed for r in cleaning_funnel(df).collect()}
    assert funnel["duplicate"] == 0 and cleaning_funnel(df).filter("step = 0").first().remaining == 1
    assert {r.ord: r.rule for r in tag_pairs(df).collect()} == {1: 1, 2: 1, 3: 1, 4: 0}


def test_unknown_consent_is_none(spark):
    pairs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d")], "ord long, session_id string")
    log = spark.createDataFrame([("a", True), ("b", False), ("c", None)], "session_id string, consent boolean")
    assert sorted(r.ord for r in consent_filter(pairs, log).collect()) == [1, 4]
    assert sorted(r.ord for r in consent_filter(pairs, log, keep_unlogged=False).collect()) == [1]


def test_padded_categories_are_one(spark):
    rows = [(i, "food" if i % 2 else "food ", "a", "b") for i in range(10)]
    df = spark.createDataFrame(rows, "ord long, category string, src string, tgt string")
    split = stratified_split(df).collect()
    assert len(split) == 10 and {r.category for r in split} == {"food"}
    assert category_report(df).first().n_pairs == 10


def test_csv_columns_go_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("category,tgt,src\nx,english,dialect\n")
    got = read_pairs_csv(spark, str(tmp_path / "a.csv"), ["src", "tgt"]).collect()
    assert [(r.src, r.tgt) for r in got] == [("dialect", "english")]
    with pytest.raises(ValueError):
        read_pairs_csv(spark, str(tmp_path / "a.csv"), ["src", "other"])
    (tmp_path / "b.csv").write_text("src,tgt\na,b\nonly\na,b,c\n")
    counts = malformed_counts(scan_csv(spark, str(tmp_path / "b.csv"), ["src", "tgt"])).collect()
    assert {r.reason: r.n_rows for r in counts} == {"well formed": 1, "too few fields": 1, "too many fields": 1}


def test_broadcast_is_decided_by_bytes(spark):
    df = spark.createDataFrame([("x" * 1000,)] * 10, "k string")
    plan = lambda x: x._jdf.queryExecution().logical().toString()
    assert "broadcast" in plan(session.small_side(df, "t", 20_000)) and "broadcast" not in plan(session.small_side(df, "t", 2_000))


def test_feed_holds_no_held_out_pair(spark):
    from pyspark.sql import functions as F

    from twinline.operators import split
    from twinline.plans import queries as named
    from twinline.plans import views as V

    sf_dir = "/root/testdata/sf0.01"  # the smallest with ten pairs of a category
    splits = split.stratified_split(V.category_pairs(spark, sf_dir))
    held = splits.filter("split <> 'train'").select(F.lower("src").alias("s"), F.lower("tgt").alias("t"), "ord")
    feed = named._feed_sources(spark, sf_dir)
    assert held.count() > 0
    assert feed.filter("source = 'base'").join(held, "ord").count() == 0
    assert feed.filter("source = 'field'").join(held, "ord").count() == 0
    low = feed.filter("source = 'base'").select(F.lower("src").alias("s"), F.lower("tgt").alias("t"))
    assert low.join(held, ["s", "t"]).count() == 0
