from __future__ import annotations

import random

from pyspark.sql import functions as F

from twinline.functions.rules import RuleSet
from twinline.operators import clean, profile, provenance, split

PAIR = "ord long, src string, tgt string"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def random_pairs(n=400, seed=3):
    rng = random.Random(seed)
    texts = ["One two three", "one TWO three", "a b", "see www.x.org now ok", "he said ya7 to me", "bzzaf is it so", "plain words in here"]
    return [(i, rng.choice(texts), rng.choice(texts)) for i in rng.sample(range(10 * n), n)]


def test_first_copy_wins_and_keeps_its_case(spark):
    rows = [(5, "AB c d", "x"), (2, "ab C d", "X"), (9, "ab c d", "y"), (4, "a", "b:x"), (7, "a:b", "x")]
    got = clean.dedup_pairs(spark.createDataFrame(rows, PAIR)).orderBy("ord").collect()
    assert [tuple(r) for r in got] == [(2, "ab C d", "X", 2), (4, "a", "b:x", 1), (7, "a:b", "x", 1), (9, "ab c d", "y", 1)]


def brute_funnel(rows):
    seen, kept, dup = set(), [], 0
    for row in sorted(rows):
        key = (row[1].lower(), row[2].lower())
        dup += key in seen
        if key not in seen:
            seen.add(key)
            kept.append(row)
    checks = [
        lambda s, t: len(s.split()) < 3 or len(t.split()) < 3,
        lambda s, t: "ya7" in t,
        lambda s, t: "www." in s + t,
        lambda s, t: "bzzaf" in s + t,
    ]
    removed = [0] * 4
    left = []
    for row in kept:
        failing = next((i for i, c in enumerate(checks) if c(row[1], row[2])), None)
        if failing is None:
            left.append(row)
        else:
            removed[failing] += 1
    return dup, removed, left


def test_funnel_and_clean_pairs_against_brute_force(spark):
    rows = random_pairs()
    dup, removed, left = brute_funnel(rows)
    for parts in (1, 17):
        df = spark.createDataFrame(rows, PAIR).repartition(parts)
        funnel = {r.rule: r.removed for r in clean.cleaning_funnel(df).collect()}
        assert funnel == {
            "original": 0, "duplicate": dup, "short": removed[0], "mixed_digits": removed[1],
            "noise": removed[2], "marker": removed[3], "total": dup + sum(removed),
        }
        assert sorted(tuple(r) for r in clean.clean_pairs(df).collect()) == left


def test_one_pair_holding_most_rows(spark):
    rows = [(i, "Same old pair", "same old text") for i in range(3000)] + [(5000 + i, f"w{i} b c", "d e f") for i in range(50)]
    df = spark.createDataFrame(rows, PAIR).repartition(16)
    got = clean.dedup_pairs(df)
    assert got.count() == 51
    assert got.filter("n_copies = 3000").select("ord").first().ord == 0


def test_empty_input(spark):
    df = spark.createDataFrame([], PAIR)
    assert {(r.rule, r.remaining) for r in clean.cleaning_funnel(df).collect()} >= {("total", 0)}
    assert clean.clean_pairs(df).count() == 0


def test_rule_parameters(spark):
    df = spark.createDataFrame([(1, "a b", "c d")], PAIR)
    assert clean.tag_pairs(df).first().rule == 1
    assert clean.tag_pairs(df, RuleSet(min_words=2)).first().rule == 0


def test_dedup_aggregates_in_two_hash_phases(spark):
    df = spark.createDataFrame(random_pairs(20), PAIR)
    plan = plan_of(clean.cleaning_funnel(df))
    assert "partial_min" in plan and "SortAggregate" not in plan
    # Only the digest, the position and the rule are shuffled.
    exchanged = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert exchanged and all("_key" in line for line in exchanged)


def test_profile_counts_each_kind_of_empty(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, " ", " "), (3, "a", "b"), (4, "a", "")], PAIR)
    got = profile.profile_pairs(df).first()
    assert (got.n_pairs, got.empty_src, got.empty_tgt, got.empty_either, got.columns) == (4, 2, 2, 3, "ord,src,tgt")
    assert {(r.side, r.n_sentences) for r in profile.corpus_sides(df).collect()} == {("src", 2), ("tgt", 2)}


def test_length_profile_is_exact(spark):
    df = spark.createDataFrame([(i, " ".join(["w"] * (i + 1)), "one") for i in range(100)], PAIR)
    src = profile.length_profile(df).filter("side = 'src'").first()
    assert (src.n_sentences, src.p50, src.longest, src.cut_share) == (100, 50.5, 100, 0.7)
    assert abs(src.p99 - 99.01) < 1e-9


CATEGORY = "category string, ord long, src string, tgt string"


def category_rows():
    rows = [(c, 1000 * k + i, f"{c} {i}", "t") for k, (c, n) in enumerate((("nine", 9), ("ten", 10), ("many", 27))) for i in range(n)]
    rows += [("many", 1, " ", "t"), (" ", 2, "s", "t"), (None, 3, "s", "t")]
    random.Random(1).shuffle(rows)
    return rows


def test_split_sizes(spark):
    for parts in (1, 17):
        df = spark.createDataFrame(category_rows(), CATEGORY).repartition(parts)
        got = {(r.category, r.split): r["count"] for r in split.stratified_split(df).groupBy("category", "split").count().collect()}
        assert got == {(c, s): n for c in ("ten", "many") for s, n in (("train", 8), ("val", 1), ("test", 1))}
        report = {r.category: (r.n_pairs, r.skipped, r.n_unused) for r in split.category_report(df).collect()}
        assert report == {"nine": (9, True, 9), "ten": (10, False, 0), "many": (27, False, 17)}
        assert [tuple(r) for r in split.skipped_categories(df).collect()] == [("nine", 9)]


def test_split_takes_first_rows(spark):
    df = spark.createDataFrame(category_rows(), CATEGORY)
    many = split.stratified_split(df).filter("category = 'many'").orderBy("ord").collect()
    assert [r.ord for r in many] == list(range(2000, 2010))
    assert [r.split for r in many] == ["train"] * 8 + ["val", "test"]


def test_split_limits_groups_before_the_shuffle(spark):
    plan = plan_of(split.split_positions(spark.createDataFrame(category_rows(), CATEGORY)))
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_leakage(spark):
    rows = [("train", 1, "A b", "x"), ("test", 2, "a B", "y"), ("test", 3, "a b", "X"), ("test", 4, "c", "x"), ("val", 5, "c", "x")]
    splits = spark.createDataFrame(rows, "split string, ord long, src string, tgt string")
    got = {r.check: r.n_rows for r in split.split_leakage(splits).collect()}
    assert got == {"test": 3, "in_train_by_src": 2, "in_train_by_pair": 1}


def test_provenance_and_consent(spark):
    pairs = spark.createDataFrame([("a", "s1"), ("a", "s2"), ("b", "s1"), (None, "s3")], "category string, source string")
    got = {(r.category, r.source, r.level): r.n_pairs for r in provenance.provenance_rollup(pairs).collect()}
    assert got[(None, None, 3)] == 4 and got[("a", None, 1)] == 2 and got[(None, "s3", 0)] == 1
    sessions = spark.createDataFrame([("s1", True), ("s2", False)], "session_id string, consent boolean")
    kept = provenance.consent_filter(pairs.withColumnRenamed("source", "session_id"), sessions)
    assert sorted(r.session_id for r in kept.collect()) == ["s1", "s1", "s3"]
