"""Field logs: Markdown notes of collection sessions, read into typed rows.

A section ``## Session 3 — Speaker (place)`` holds bullets ``- **Name:** text``, which may run over lines. Sections of
one file may follow any preamble; comments are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_HEAD = "\n## Session "
_NO = r"(?i)^(?:no|none|not|refused|withheld|denied)\b"


def _filled(text: Column) -> Column:
    """One line without outer space; null if nothing is left."""
    line = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(line != "", line)


def _bullet(section: Column, name: str) -> Column:
    """What follows ``- **name:**`` up to the next bullet, rule or blank line."""
    return _filled(F.regexp_extract(section, rf"(?s)\n- \*\*{name}:\*\*(.*?)(?=\n- |\n---|\n\s*\n|\z)", 1))


def read_field_log(spark: SparkSession, path: str) -> DataFrame:
    """``session, title, collected, place, consent_note, consent, source, category, n_pairs`` of every session and category.

    ``consent`` is true where a note says what was agreed, false where the note refuses or the session is marked excluded, and
    null where the log does not tell. A session without counted pairs has one row without a category. Files are whole
    rows, so a folder of logs is read by many tasks.
    """
    text = F.regexp_replace("value", r"(?s)<!--.*?-->", "")
    text = F.regexp_replace(text, "\r\n?", "\n")
    sections = F.split(F.concat(F.lit("\n"), text), _HEAD)
    found = spark.read.text(path, wholetext=True).select(
        F.explode(F.slice(sections, F.lit(2), F.greatest(F.size(sections) - 1, F.lit(0)))).alias("s")
    )
    s = F.col("s")
    noted = found.select(
        F.regexp_extract(s, r"^([0-9]+)", 1).try_cast("int").alias("session"),
        _filled(F.regexp_extract(s, r"^[0-9]*\s*[—–-]?([^\n]*)", 1)).alias("title"),
        _bullet(s, "Collected").alias("collected"),
        _bullet(s, "Place").alias("place"),
        _bullet(s, "Consent").alias("consent_note"),
        _bullet(s, "Pairs").alias("_pairs"),
    )
    excluded = F.coalesce(F.col("collected").rlike(r"(?i)\bexcluded\b"), F.lit(False))
    note, pairs = F.col("consent_note"), F.col("_pairs")
    consent = F.when(excluded | F.coalesce(note.rlike(_NO), F.lit(False)), False).when(note.isNotNull(), True)
    source = F.regexp_extract(pairs, r"source `([^`]+)`", 1)
    # "18 — source `x`: 1 in `a`, 7 in `b`", or "10 — category `a`, source `x`".
    several = F.lit(r"([0-9]+) in `([^`]+)`")
    counts, names = (F.regexp_extract_all(pairs, several, F.lit(k)) for k in (1, 2))
    only = F.regexp_extract(pairs, r"category `([^`]+)`", 1)
    whole = F.array(
        F.struct(F.when(only != "", only).alias("category"), F.regexp_extract(pairs, r"^([0-9]+)", 1).try_cast("int").alias("n_pairs"))
    )
    each = F.transform(F.arrays_zip(names.alias("c"), counts.alias("n")), lambda x: F.struct(x["c"].alias("category"), x["n"].try_cast("int").alias("n_pairs")))
    return noted.select(
        "session", "title", "collected", "place", "consent_note", consent.alias("consent"),
        F.when(source != "", source).alias("source"), F.inline_outer(F.when(F.size(counts) > 0, each).otherwise(whole)),
    )


def session_notes(sessions: DataFrame) -> DataFrame:
    """Markdown sections, one row each, of ``session, source, consent, counts`` (an array of ``category, n_pairs``).

    The reverse of :func:`read_field_log` for these columns: a missing consent writes no note.
    """
    listed = F.array_join(
        F.transform("counts", lambda c: F.concat(c["n_pairs"].cast("string"), F.lit(" in `"), c["category"], F.lit("`"))), ", "
    )
    total = F.aggregate("counts", F.lit(0).cast("long"), lambda a, c: a + c["n_pairs"])
    consent = F.when(F.col("consent"), "\n- **Consent:** agreed to publication").when(~F.col("consent"), "\n- **Consent:** refused")
    return sessions.select(
        F.concat(
            F.lit("## Session "), F.col("session").cast("string"), F.lit(" — "), F.col("source"), F.coalesce(consent, F.lit("")),
            F.lit("\n- **Pairs:** "), total.cast("string"), F.lit(" — source `"), F.col("source"), F.lit("`: "), listed, F.lit("\n"),
        ).alias("value")
    )
