from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from twinline.operators.profile import stack_sides
from twinline.session import discard, materialize, scratch_root, store
from twinline.sources import sinks, tables
from twinline.streaming import clean_stream

NASTY = [
    ('he said "hi", ok', "line one\nline two"),
    ("  padded  ", "tab\t"),
    ("back\\slash", "comma, 'quote'"),
    ("é中", "\U0001F600 x"),
]


def test_quoted_sink_keeps_every_character(spark, tmp_path):
    path = str(tmp_path / "out")
    sinks.write_clean(spark.createDataFrame(NASTY, "src string, tgt string"), path)
    good, bad = tables.quarantine(tables.scan_csv(spark, path, ["src", "tgt"]))
    assert sorted(tuple(r) for r in good.collect()) == sorted(NASTY) and bad.count() == 0
    report = sinks.sink_report(spark, path, ["src", "tgt"]).first()
    files = list((tmp_path / "out").glob("*.csv"))
    assert report.n_rows == 4 and report.n_bytes == sum(f.stat().st_size for f in files)


def test_files_stay_small(spark, tmp_path):
    df = spark.range(10).select(F.col("id").cast("string").alias("src"), F.lit("t").alias("tgt")).coalesce(1)
    sinks.write_clean(df, str(tmp_path / "out"), rows_per_file=3)
    assert len(list((tmp_path / "out").glob("*.csv"))) == 4
    assert sinks.sink_report(spark, str(tmp_path / "out"), ["src", "tgt"]).first().n_rows == 10


def test_malformed_rows_are_set_apart(spark, tmp_path):
    path = tmp_path / "raw.csv"
    path.write_text(
        'category,src,tgt\na,"he said ""hi"", ok",t1\nb,only two\nc,x,y,surplus\nd,"two\nlines", t4 \n\ne,,t5\n'
    )
    columns = ["category", "src", "tgt"]
    _, bad = tables.quarantine(tables.scan_csv(spark, str(path), columns))
    assert sorted(r.raw for r in bad.collect()) == ["b,only two", "c,x,y,surplus"]
    good = tables.read_pairs_csv(spark, str(path), columns)
    assert sorted(tuple(r) for r in good.collect()) == [("a", 'he said "hi", ok', "t1"), ("d", "two\nlines", "t4")]
    kept = tables.read_pairs_csv(spark, str(path), columns, required=["tgt"])
    assert kept.count() == 3 and kept.filter("src is null").count() == 1
    # The flag survives a query of a single column.
    assert sorted(r.category for r in good.select("category").collect()) == ["a", "d"]


def test_splits_are_pruned_by_folder(spark, tmp_path):
    path = str(tmp_path / "splits")
    rows = [("train", "c", "s1", "t1"), ("test", "c", "s2", "t2")]
    sinks.write_splits(spark.createDataFrame(rows, "split string, category string, src string, tgt string"), path)
    back = tables.read_pairs_csv(spark, path, ["category", "src", "tgt"], partitions=("split",))
    assert sorted(tuple(r) for r in back.collect()) == sorted(rows)
    plan = back.filter("split = 'test'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan


def test_line_corpus(spark, tmp_path):
    pairs = spark.createDataFrame([(1, "a", "b"), (2, " ", "c")], "ord long, src string, tgt string")
    sinks.write_corpus(stack_sides(pairs), str(tmp_path / "c"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "c")).collect()) == ["a", "b", "c"]


def test_scratch_follows_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        assert scratch_root(spark) == named.rstrip("/")
    df = materialize(spark.range(5), "t")
    assert df.count() == 5 and "Range" not in df._jdf.queryExecution().logical().toString()


def test_rules_run_on_streams(spark, tmp_path):
    rows = [(1, " one two three ", "four five six"), (2, "a b", "c d e"), (3, "see me @home ok", "x y z"), (4, None, "x y z")]
    schema = "ord long, src string, tgt string"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    stream = clean_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    query = (
        stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck"))
        .trigger(availableNow=True).start(str(tmp_path / "out"))
    )
    assert query.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [tuple(r) for r in got] == [(1, "one two three", "four five six")]


def test_discard_refuses_foreign_paths(spark, tmp_path):
    stored, path = store(spark.range(3), "t")
    assert stored.count() == 3
    discard(spark, path)
    with pytest.raises(Exception):
        spark.read.parquet(path).count()
    with pytest.raises(ValueError):
        discard(spark, str(tmp_path))
