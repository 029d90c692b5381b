"""Text primitives shared by every operator: strip, count, boundaries, folding."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The characters Python's str.strip() and str.split() treat as whitespace.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The same set as the inside of a regex class, valid in Java and in RE2.
SPACE = (
    r"\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)

# Python's Unicode word boundary, spelled out: Java's own \b counts combining marks
# and joiners as word characters, Python's does not.
WORD_START = r"(?<![\p{L}\p{N}_])"
WORD_END = r"(?![\p{L}\p{N}_])"


def strip(col: Column) -> Column:
    """Unicode-aware strip. Texts without outer whitespace skip the slower trim."""
    text = col.cast("string")
    padded = F.substring(text, 1, 1).isin([*WHITESPACE]) | F.substring(text, -1, 1).isin([*WHITESPACE])
    return F.when(padded, F.btrim(text, F.lit(WHITESPACE))).otherwise(text)


def is_filled(col: Column) -> Column:
    """True when the value is neither null nor whitespace only; stops at the first letter."""
    return F.coalesce(col.cast("string").rlike(f"[^{SPACE}]"), F.lit(False))


def words(col: Column) -> Column:
    """Whitespace-separated words of a text; an empty text has none."""
    return F.filter(F.split(col, f"[{SPACE}]+"), lambda w: w != "")


def word_count(col: Column) -> Column:
    """Number of whitespace-separated words."""
    return F.size(words(col))


def has_min_words(col: Column, n: int) -> Column:
    """``word_count(col) >= n``, decided as soon as the n-th word starts."""
    if n <= 0:
        return F.lit(True)
    return col.rlike(f"(?:[^{SPACE}]++[{SPACE}]++){{{n - 1}}}[^{SPACE}]")


# Fixed values of the subword normalization: controls that vanish, and marks that
# become a plain space before compatibility composition and case folding.
_REMOVED = "".join(map(chr, [*range(0x01, 0x09), 0x0B, *range(0x0E, 0x20), 0x7F, 0x8F, 0x9F]))
_SPACED = (
    "\t\n\x0c\r\u1680\u200b\u200c\u200d\u200e\u200f\u2028\u2029\u2581\ufeff\ufffd"
)
_FOLD_TABLE = str.maketrans({**dict.fromkeys(_REMOVED), **dict.fromkeys(_SPACED, " ")})
_SPACE_RUN = re.compile(" +")


def fold(text: str) -> str:
    """NFKC plus case folding, one space between words, none at the ends."""
    text = unicodedata.normalize("NFKC", text.translate(_FOLD_TABLE)).casefold()
    return _SPACE_RUN.sub(" ", unicodedata.normalize("NFKC", text)).strip(" ")


@F.pandas_udf(T.StringType())
def nfkc_fold(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Column form of :func:`fold`. Spark SQL has no NFKC."""
    for texts in batches:
        yield texts.map(fold, na_action="ignore")
