from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from twinline.functions import rules as R
from twinline.functions.text import WHITESPACE, fold, has_min_words, is_filled, nfkc_fold, strip, word_count

ACUTE = "́"
JOINER = "‍"


def evaluate(spark, texts, *columns):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [tuple(r)[1:] for r in df.select("i", *columns).orderBy("i").collect()]


def test_whitespace_set_is_pythons():
    assert sorted(WHITESPACE) == sorted(chr(c) for c in range(0x110000) if chr(c).isspace())


@pytest.mark.parametrize(
    "test, hits, misses",
    [
        (
            R.has_mixed_digits,
            ["ya7", "7alak", "20th", "b0b", "e" + ACUTE + "7a", "7a" + JOINER, "x-7a"],
            ["3", "room 5", "1st", "a_7b", "é7a", "İ7a", "12 b", ""],
        ),
        (R.has_url, ["visit foo.com now", "HTTP://x", "https://", "WWW.x", "a.net", "a.ORG!"], ["http x", "foo.community", "dot com"]),
        (R.has_bare_http, ["http x", "an HTTP."], ["https", "xhttp", "http_", "http2", "éhttp"]),
        (R.has_at_or_hash, ["a@b", "#"], ["ab"]),
        (R.has_emoji, ["\U0001F600", "a☀", "\U0001F1E6", "\U0001F9FF", "➿"], ["◿", "\U0001F650", "é", "plain"]),
        (
            R.has_marker,
            ["KIF 7alak", "KIF 7alak", "bel zaf!", "belzaf", "Kif 7alak", "kıf halak"],
            ["bébzzaf", "bzzafa", "kif", "zaf"],
        ),
    ],
)
def test_hostile_strings(spark, test, hits, misses):
    got = evaluate(spark, hits + misses, test(F.col("t")).alias("x"))
    assert [g for (g,) in got] == [True] * len(hits) + [False] * len(misses)


def test_rules_match_python_re_on_random_strings(spark):
    """The same rules written for Python's engine, on strings that mix hostile characters."""
    rng = random.Random(5)
    bits = [
        "http", "https://", "www.", ".com", ".net", ".org", "@", "#", "bzzaf", "bel", "zaf", "kif", "7alak", "halak",
        "7", "3", "a", "B", "_", " ", " ", "\x1f", "é", "e" + ACUTE, JOINER, "-", ".", "\U0001F600", "٠", "Ⅴ",
        "ſ", "K", "ı", "1", "x",
    ]
    texts = ["".join(rng.choices(bits, k=rng.randint(1, 8))) for _ in range(1500)]
    word = re.compile(r"\w+")

    def mixed(t):
        ascii_word = lambda w: w.isascii() and "_" not in w
        return any(
            ascii_word(w) and any(d in w for d in R.DIGITS) and any(c.isalpha() for c in w) for w in word.findall(t)
        )

    marker = re.compile(r"\b(" + "|".join(r"\s*".join(t) for t in R.MARKERS) + r")\b", re.I)
    expected = [
        (
            mixed(t),
            bool(re.search(r"https?://|www\.|\.(com|net|org)\b", t, re.I)),
            bool(re.search(r"\bhttp\b", t, re.I)),
            bool(marker.search(t)),
            len(t.split()),
            len(t.split()) >= 3,
            t.strip(),
            bool(t.strip()),
        )
        for t in texts
    ]
    c = F.col("t")
    tests = [R.has_mixed_digits(c), R.has_url(c), R.has_bare_http(c), R.has_marker(c)]
    others = [word_count(strip(c)), has_min_words(c, 3), strip(c), is_filled(c)]
    got = evaluate(spark, texts, *[x.alias(f"c{i}") for i, x in enumerate(tests + others)])
    for t, g, e in zip(texts, got, expected):
        assert g == e, repr(t)


def test_unguarded_marker_terms(spark):
    terms = [("si", "is")]  # nothing but letters with three cases: no guard is possible
    got = evaluate(spark, ["a Sı İs", "SI is", "sixis"], R.has_marker(F.col("t"), terms).alias("x"))
    assert [g for (g,) in got][1:] == [True, False]


def test_word_count_and_strip(spark):
    got = evaluate(spark, ["a b c", "x\x1fy", " 　", "", None], word_count(F.col("t")), strip(F.col("t")))
    assert [g[0] for g in got[:4]] == [3, 2, 0, 0]
    assert [g[1] for g in got] == ["a b c", "x\x1fy", "", "", None]


def test_fold(spark):
    texts = ["ＡＢ Straße​x", "ﬁn\x01e", "▁a", "  ", None]
    assert [fold(t) for t in texts[:4]] == ["ab strasse x", "fine", "a", ""]
    assert evaluate(spark, texts, nfkc_fold("t")) == [("ab strasse x",), ("fine",), ("a",), ("",), (None,)]
