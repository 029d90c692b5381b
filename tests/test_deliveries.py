"""Field logs, quarantine in one pass, resumed streams, sketches, term tables, leaks and the learned queries."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tests.check import compare, open_tables
from tests.conftest import SF_DIR
from twinline.functions import rules as R
from twinline.operators import bleu, mix, profile, sketches, split, terms
from twinline.plans import oracles, queries
from twinline.plans import views as V
from twinline.session import small_side
from twinline.sources import fieldlog, tables
from twinline.streaming import run_clean_stream

LOG = """# Log

Preamble.

## Session 1 — A neighbour (market)
- **Collected:** early June (from memory)
- **Place:** home
- **Consent:** family, knows that
  pairs are published
- **Pairs:** 10 — category `food`, source `family-a`
- **Context/notes:** none

## Session 2 — Somebody (cafe)
- **Collected:** June 11
- **Consent:** refused afterwards
- **Pairs:** 18 — source `community-b`: 1 in `greetings` (one variant),
  7 in `food` (more), 10 in `work`

## Session 3 — Left out
- **Collected:** June 11 — EXCLUDED from the data
- No pairs.

## Session 4 — Unknown
- **Pairs:** 3 — category `work`, source `c`

<!-- ## Session N — template
- **Consent:** <what> -->
"""


def test_field_log(spark, tmp_path):
    (tmp_path / "log.md").write_text(LOG.replace("\n", "\r\n"))
    (tmp_path / "empty.md").write_text("nothing here\n")
    got = [tuple(r) for r in fieldlog.read_field_log(spark, str(tmp_path)).select(
        "session", "title", "place", "consent_note", "consent", "source", "category", "n_pairs"
    ).orderBy("session", "n_pairs").collect()]
    assert got == [
        (1, "A neighbour (market)", "home", "family, knows that pairs are published", True, "family-a", "food", 10),
        (2, "Somebody (cafe)", None, "refused afterwards", False, "community-b", "greetings", 1),
        (2, "Somebody (cafe)", None, "refused afterwards", False, "community-b", "food", 7),
        (2, "Somebody (cafe)", None, "refused afterwards", False, "community-b", "work", 10),
        (3, "Left out", None, None, False, None, None, None),
        (4, "Unknown", None, None, None, "c", "work", 3),
    ]


def test_quarantine_is_one_pass(spark, tmp_path):
    (tmp_path / "in.csv").write_text('category,src,tgt\na,b,c\nshort,x\nlong,x,y,z\n,,\n')
    scanned = tables.scan_csv(spark, str(tmp_path / "in.csv"), ["category", "src", "tgt"])
    counts = tables.write_quarantined(scanned, str(tmp_path / "out"))
    assert counts == {"well formed": 2, "empty": 0, "too many fields": 1, "too few fields": 1}
    rows = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.outcome, r.reason, r.raw) for r in rows.collect() if r.raw) == [
        ("bad", "too few fields", "short,x"), ("bad", "too many fields", "long,x,y,z")
    ]
    assert {r.outcome: r["count"] for r in rows.groupBy("outcome").count().collect()} == {"good": 2, "bad": 2}


def test_stream_resumes_without_repeats(spark, tmp_path):
    schema = "ord long, src string, tgt string"
    source, sink, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    run = lambda: run_clean_stream(spark, source, schema, lambda df: df, sink, state)
    spark.createDataFrame([(1, "one two three", "four five six"), (2, "a", "b")], schema).write.parquet(source)
    assert run() == 1 and run() == 0
    spark.createDataFrame([(3, " one two four ", "five six seven"), (4, None, "x")], schema).write.mode("append").parquet(source)
    assert run() == 1
    assert sorted(map(tuple, spark.read.schema(schema).parquet(sink).collect())) == [
        (1, "one two three", "four five six"), (3, "one two four", "five six seven")
    ]


def test_sketches_merge_to_one_pass(spark):
    pairs = V.doc_pairs(spark, "/root/testdata/sf0.01")
    parts = [sketches.delivery_sketches(pairs.filter(F.col("ord") % 3 == k)) for k in range(3)]
    merged = sketches.merged_sketches(parts[0].unionByName(parts[1]).unionByName(parts[2]), "side")
    got = {r.side: r for r in sketches.sketch_report(merged).collect()}
    words = {r.side: r.n_words for r in profile.word_vocab_size(pairs).collect()}
    lengths = {}
    for r in pairs.select("src", "tgt").collect():
        for side in ("src", "tgt"):
            lengths.setdefault(side, []).append(len(r[side].split()))
    for side, values in lengths.items():
        values.sort()
        assert got[side].n_sentences == len(values)
        assert abs(got[side].n_words - words[side]) < 0.03 * words[side]
        for p, found in ((0.5, got[side].p50), (0.99, got[side].p99)):
            below, upto = sum(v < found for v in values), sum(v <= found for v in values)
            assert below - 0.01 * len(values) <= p * len(values) <= upto + 0.01 * len(values)


def test_many_terms_equal_the_pattern(spark):
    found = [("bel", "zaf"), ("of", "the"), ("kif",), ("a", "b", "c"), ("7ala", "k")]
    texts = [
        "KIF 7alak", "bel zaf!", "bel   zaf", "belzaf", "bébelzaf", "bel, zaf", "xof the", "of thex", "of\nthe", "a bc", "ab c", "a b c",
        "abc", "a b", "", None, "kif_", "of the of the", "7alak 7ala k", "a a b c",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    hits = {(r.doc_id, r.term) for r in terms.term_hits(docs, terms.term_table(spark, found)).collect()}
    for term in found:
        want = {r.doc_id for r in docs.filter(R.has_marker(F.col("text"), [term])).collect()}
        assert {d for d, t in hits if t == " ".join(term)} == want, term
    assert terms.term_hits(docs, terms.term_table(spark, found).limit(0)).count() == 0


def test_term_hits_read_the_texts_once(spark, tmp_path):
    texts = [(1, "x a b c d"), (None, "a b c"), (None, "a b c"), (2, "abc d. a bcd"), (3, None), (4, "a b. c"), (5, "a\u00a0b\tc e\u0301")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    docs = tables.scan_table(spark, f"{tmp_path}/documents.parquet", "doc_id long, text string")
    listed = spark.createDataFrame(
        [("abc", ["a", "b", "c"]), ("same", ["A", "b", "C"]), ("d", ["d"]), ("a b", ["a b"]), ("none", ["a", None]), ("no parts", None), ("gap", ["", "a"])],
        terms.TERM,
    )
    want = {(1, "abc"), (1, "same"), (1, "d"), (None, "abc"), (None, "same"), (2, "abc"), (2, "same"), (2, "d"), (5, "abc"), (5, "same"), (1, "gap"), (None, "gap"), (2, "gap"), (4, "gap"), (5, "gap")}
    hits = terms.term_hits(docs, listed)
    got = [tuple(r) for r in hits.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert hits._jdf.queryExecution().optimizedPlan().toString().count("Relation [doc_id") == 1


def test_term_hits_of_a_trie_too_large_to_send(spark, monkeypatch):
    monkeypatch.setattr(terms, "small_side", lambda df, label: small_side(df, label, max_bytes=0))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = spark.createDataFrame([(1, "a b c"), (2, "ab c a"), (3, "a c"), (4, " b  c a b")], "doc_id long, text string")
        got = [tuple(r) for r in terms.term_hits(docs, terms.term_table(spark, [("a", "b", "c"), ("b", "c"), ("c",)])).collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted(got) == [(1, "a b c"), (1, "b c"), (1, "c"), (2, "a b c"), (2, "c"), (3, "c"), (4, "b c"), (4, "c")]


def test_planted_leaks_are_found(spark):
    rows = [("train", 1, "a b", "x"), ("train", 2, "c", "y"), ("val", 3, "A b", "X"), ("test", 4, "c", "z"), ("test", 5, "q", "q")]
    splits = spark.createDataFrame(rows, "split string, ord long, src string, tgt string")
    feed = spark.createDataFrame([("q", "Q"), (None, "x")], "src string, tgt string")
    got = {(r.corpus, r.split, r.by): (r.n_held_out, r.n_found) for r in split.leak_report(splits, {"train": splits.filter("split = 'train'"), "feed": feed}).collect()}
    assert got == {
        ("train", "val", "src"): (1, 1), ("train", "val", "pair"): (1, 1), ("train", "test", "src"): (2, 1), ("train", "test", "pair"): (2, 0),
        ("feed", "val", "src"): (1, 0), ("feed", "val", "pair"): (1, 0), ("feed", "test", "src"): (2, 1), ("feed", "test", "pair"): (2, 1),
    }
    report = mix.feed_report(spark.range(100), spark.range(7), 32, 4, 20).first()
    assert tuple(report) == (100, 7, 3, 60, 128)


def test_gram_arrays_equal_counted_rows(spark):
    rows = [(1, "a a a b", "a a b b"), (2, None, "a"), (3, "x", None), (4, "", "a b"), (5, "a a a b", "a b a b")]
    segments = spark.createDataFrame(rows, "seg_id long, hypothesis string, reference string")
    counted = bleu.ngram_counts(segments).groupBy("n").agg(
        F.sum(F.least("hyp_count", "ref_count")).alias("matches"), F.sum("hyp_count").alias("hyp_total"), F.sum("ref_count").alias("ref_total")
    )
    assert sorted(map(tuple, bleu.clipped_matches(segments).collect())) == sorted(map(tuple, counted.collect()))


@pytest.fixture(scope="module")
def small_vocabulary():
    patch = pytest.MonkeyPatch()
    patch.setattr(queries, "VOCAB", oracles.SMALL_VOCAB)
    yield
    patch.undo()


@pytest.mark.parametrize("name", sorted(oracles.LEARNED))
def test_learned_queries_equal_sql_for_a_small_vocabulary(spark, small_vocabulary, name):
    assert compare(spark, open_tables(SF_DIR), SF_DIR, name, oracles.learned_sql()[name]) == ""
