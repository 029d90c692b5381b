"""Quality rules: a threshold table compiled into one Spark projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
MARKS = r"[#*$%&|<>!?@~^=+_{}\[\]]"
WINDOW = 8

# Frequent function words of the corpus languages.
STOP_WORDS = (
    "the of and to in a is that it for on was as with be by are this at an from "
    "de la le les des et en que un une du est pour dans qui au par sur pas "
    "der die und den von zu das mit sich auf für ist im nicht ein eine dem "
    "el los las se y del por con para una al lo no"
).split()

# (ratio, at least, at most): a document is kept when every ratio lies within its bounds.
THRESHOLDS: tuple[tuple[str, float | None, float | None], ...] = (
    ("mean_word_chars", 2.0, 15.0),
    ("symbols_per_word", None, 0.1),
    ("marks_per_word", None, 0.3),
    ("stop_word_ratio", 0.05, None),
    ("dup_line_ratio", None, 0.5),
)


def repeated_words(words: Column, frame: DataFrame) -> DataFrame:
    """``frame`` with ``n_repeat_words``: words in 8-word windows found twice or more in the text.

    Windows are compared by 64-bit hash. Only texts with a repeated window are sorted, by (hash, place).
    """
    frame = frame.withColumn("_w", F.transform(words, lambda w: F.xxhash64(w)))
    n = F.size("_w")
    later = [lambda i, k=k: F.get(F.col("_w"), i + k) for k in range(1, WINDOW)]
    windows = F.transform("_w", lambda h, i: F.xxhash64(h, *[at(i) for at in later]))
    whole = F.slice(windows, 1, n - WINDOW + 1)
    frame = frame.withColumn("_w", F.when(n >= WINDOW, whole).otherwise(F.array().cast("array<bigint>")))
    frame = frame.withColumn(
        "_s",
        F.when(
            F.size(F.array_distinct("_w")) < F.size("_w"),
            F.array_sort(F.transform("_w", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    )
    same = lambda s, j: F.coalesce(s["h"] == F.get(F.col("_s"), j)["h"], F.lit(False))
    frame = frame.withColumn(
        "_p",
        F.array_sort(
            F.transform(F.filter("_s", lambda s, j: same(s, j - 1) | same(s, j + 1)), lambda s: s["i"])
        ),
    )
    start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("total"))
    covered = F.aggregate(
        F.col("_p"),
        start,
        lambda a, p: F.struct(p.alias("last"), (a["total"] + F.least(F.lit(WINDOW), p - a["last"])).alias("total")),
        lambda a: a["total"],
    )
    return frame.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("_w", "_s", "_p")


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with its counts and ratios, each prefixed ``q_``; null texts count as empty.

    Ratios of a text without words, or without lines, are 0. Other columns pass untouched: input names
    that begin with ``q_`` or ``_`` are refused, as they would clash.
    """
    clash = [c for c in docs.columns if c.startswith(("q_", "_")) or c == "n_repeat_words"]
    if clash:
        raise ValueError(f"columns clash with the measures: {clash}")
    body = F.coalesce(F.col(text), F.lit(""))
    frame = docs.withColumn("_text", body).withColumn("_words", F.regexp_extract_all("_text", F.lit(WORD), F.lit(0)))
    frame = frame.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    frame = repeated_words(F.col("_words"), frame)
    words, lines, t = F.col("_words"), F.col("_lines"), F.col("_text")
    measures = {
        "q_words": F.size(words),
        "q_word_chars": F.length(F.array_join(words, "")),
        "q_symbols": F.regexp_count(t, F.lit(SYMBOLS)),
        "q_marks": F.regexp_count(t, F.lit(MARKS)),
        "q_lines": F.size(lines),
        "q_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "q_repeat_words": F.col("n_repeat_words"),
        "q_stops": F.size(F.filter(words, lambda w: F.lower(w).isin(STOP_WORDS))),
    }
    # A filter on the verdict would be pushed down with copies of every expression: a generator stops it.
    row = F.struct(*[v.cast("long").alias(k) for k, v in measures.items()])
    return frame.select(*docs.columns, F.inline(F.array(row)))


def ratios() -> dict[str, Column]:
    """The measured ratios by their name in the table."""
    per = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return {
        "mean_word_chars": per("q_word_chars", "q_words"),
        "symbols_per_word": per("q_symbols", "q_words"),
        "marks_per_word": per("q_marks", "q_words"),
        "stop_word_ratio": per("q_stops", "q_words"),
        "dup_line_ratio": per("q_dup_lines", "q_lines"),
    }


def compile_rules(table=THRESHOLDS) -> Column:
    """One condition from a threshold table."""
    have, verdict = ratios(), F.lit(True)
    for name, low, high in table:
        if low is not None:
            verdict = verdict & (have[name] >= low)
        if high is not None:
            verdict = verdict & (have[name] <= high)
    return verdict


def base_failed() -> Column:
    """Fewer than 20 words, or more than 30 % of the words in repeated windows."""
    return (F.col("q_words") < 20) | (100 * F.col("q_repeat_words") > 30 * F.col("q_words"))


def judge(docs: DataFrame, text: str = "text", table=THRESHOLDS) -> DataFrame:
    """:func:`measure` with ``q_base_failed`` and ``q_kept``. One row out per row in; an empty table gives none."""
    measured = measure(docs, text).withColumn("q_base_failed", base_failed())
    return measured.withColumn("q_kept", ~F.col("q_base_failed") & compile_rules(table))
