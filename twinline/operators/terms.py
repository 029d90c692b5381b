"""Texts that hold any of many terms: terms as a table, met by joins on words.

A term is a list of parts that may or may not have white space between them, at word boundaries, in any case: the rule
``has_marker`` for lists too long for one pattern. Each way to write the parts as words is a path of words; the
prefixes of all paths form a trie. A text's words are looked up in the trie, one join a depth, so only the
words that begin some term are ever extended.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinline.functions.text import SPACE
from twinline.session import materialize, small_side

TERM = "term string, parts array<string>"


def term_table(spark: SparkSession, terms: Iterable[tuple[str, ...]]) -> DataFrame:
    return spark.createDataFrame([(" ".join(t), list(t)) for t in terms], TERM)


def _spellings(parts: Column) -> Column:
    """All ways to join neighbouring parts to words: arrays of words."""
    start = F.array(F.array(F.element_at(parts, 1)))
    rest = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))

    def longer(ways: Column, part: Column) -> Column:
        apart = F.transform(ways, lambda w: F.array_append(w, part))
        joined = F.transform(
            ways, lambda w: F.array_append(F.slice(w, F.lit(1), F.size(w) - 1), F.concat(F.element_at(w, -1), part))
        )
        return F.concat(apart, joined)

    return F.aggregate(rest, start, longer)


def term_paths(terms: DataFrame) -> DataFrame:
    """``term, words``: the lower-cased word sequences that spell a term."""
    lowered = F.transform("parts", F.lower)
    return terms.filter(F.size("parts") > 0).select("term", F.explode(_spellings(lowered)).alias("words")).distinct()


def term_nodes(paths: DataFrame) -> DataFrame:
    """``n, path, ends, more``: every prefix of a path, of ``n`` words; whether it is a path, and whether longer ones go on."""
    size = F.size("words")
    prefix = F.struct(F.col("i").alias("n"), F.array_join(F.slice("words", F.lit(1), F.col("i")), " ").alias("path"))
    cut = paths.select("words", F.explode(F.sequence(F.lit(1), size)).alias("i")).select(prefix.alias("at"), (F.col("i") == size).alias("last"))
    return cut.groupBy("at.n", "at.path").agg(F.max("last").alias("ends"), F.max(~F.col("last")).alias("more"))


def term_hits(docs: DataFrame, terms: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, term`` of every document and term that it holds, each once; keys should be unique.

    Null texts hold none. Words are runs of letters, digits and ``_``; only white space may lie between the words of
    a term, and a part is such a run. The trie goes to the tasks while its bytes allow, else it is joined by shuffle.
    Texts are read once: a row is a word with the few that follow it, and walks down the trie by itself.
    """
    # A path of a missing or empty word meets no text.
    spelt = term_paths(terms).filter(F.forall("words", lambda w: F.coalesce(w != "", F.lit(False))))
    paths = materialize(spelt.select("term", "words", F.array_join("words", " ").alias("path"), F.size("words").alias("n")), "term-paths")
    depth = paths.agg(F.max("n").alias("n")).first()["n"] or 0
    if depth == 0:
        return docs.limit(0).select(F.col(key).alias(key), F.lit("").alias("term"))
    nodes = materialize(term_nodes(paths), "term-nodes")
    # Common letters first: a class is tried from the left.
    segments = F.split(F.lower(text), rf"[^a-z \p{{L}}\p{{N}}_{SPACE}]+")
    words = docs.select(F.col(key).alias("key"), F.explode(segments).alias("s")).select(
        "key", F.array_remove(F.split("s", r"[^a-z\p{L}\p{N}_]+"), "").alias("w")
    )
    # Each word with the few that follow it in its segment; not the whole segment a word.
    names = [f"w{n}" for n in range(1, depth + 1)]
    after = F.transform("w", lambda w, i: F.struct(w.alias("w1"), *[F.get("w", i + n).alias(f"w{n + 1}") for n in range(1, depth)]))
    alive = words.select("key", F.inline(after))
    for n in range(1, depth + 1):
        level = nodes.filter(F.col("n") == n).select(
            F.col("path").alias(f"p{n}"), F.col("ends").alias(f"ends{n}"), F.col("more").alias(f"more{n}")
        )
        if n == 1:
            alive = alive.join(small_side(level, "term-level"), F.col("w1") == F.col("p1"))
            continue
        longer = F.when(F.col(f"more{n - 1}"), F.concat(f"p{n - 1}", F.lit(" "), f"w{n}"))
        # Rows that go no further get keys of their own, which no path has, so a shuffle does not gather them.
        own = F.concat(F.lit(" "), F.xxhash64("key", *names).cast("string"))
        alive = alive.withColumn("next", F.coalesce(longer, own))
        alive = alive.join(small_side(level, "term-level"), F.col("next") == F.col(f"p{n}"), "left").drop("next")
    at = [F.when(F.col(f"ends{n}"), F.struct(F.lit(n).alias("n"), F.col(f"p{n}").alias("path"))) for n in range(1, depth + 1)]
    ended = alive.filter(F.coalesce(*[F.when(F.col(f"ends{n}"), True) for n in range(1, depth + 1)], F.lit(False)))
    met = ended.select("key", F.inline(F.array_compact(F.array(*at))))
    found = met.join(small_side(paths.select("n", "path", "term"), "term-ends"), ["n", "path"]).select("key", "term")
    return found.distinct().withColumnRenamed("key", key)
