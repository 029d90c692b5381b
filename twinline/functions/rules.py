"""Cleaning rules as Column predicates. All are native expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from twinline.functions.text import SPACE, WORD_END, WORD_START, has_min_words

# The digits used as letters, what opens a link, what closes a site name, the
# code-point ranges read as emoji, and the dialect terms whose parts may be joined or spaced.
DIGITS = "37950"
LINK_STARTS = ("http://", "https://", "www.")
SITE_ENDS = (".com", ".net", ".org")
EMOJI = (
    (0x1F600, 0x1F64F),
    (0x1F300, 0x1F5FF),
    (0x1F680, 0x1F6FF),
    (0x1F1E0, 0x1F1FF),
    (0x2700, 0x27BF),
    (0x1F900, 0x1F9FF),
    (0x2600, 0x26FF),
)
MARKERS = (("bzzaf",), ("bel", "zaf"), ("bil", "zaf"), ("kif", "7alak"), ("kif", "halak"))


# The patterns below are exact but slow on long texts. Each one is guarded by a plain search for
# something every match must hold, mostly in the lower-cased text, which callers that
# have it pass as ``low``. Lower-casing finds every letter that a case-blind pattern
# accepts, save for "i" and "s", which also have the partners U+0131 and U+017F.
_TWO_CASED = re.compile("[a-hj-rt-z0-9]+")


def _contains_any(low: Column, parts: Iterable[str]) -> Column:
    return reduce(Column.__or__, [low.contains(p) for p in dict.fromkeys(parts)])


def has_mixed_digits(col: Column, digits: str = DIGITS) -> Column:
    """Some ASCII word holds one of ``digits`` and a letter."""
    return col.rlike(f"[{digits}]") & col.rlike(
        f"{WORD_START}(?=[a-zA-Z0-9]*[{digits}])[0-9]*[a-zA-Z][a-zA-Z0-9]*+{WORD_END}"
    )


def has_url(col: Column, low: Column | None = None) -> Column:
    low = F.lower(col) if low is None else low
    starts, ends = ("|".join(map(re.escape, parts)) for parts in (LINK_STARTS, SITE_ENDS))
    # "https" holds an "s", so the guard asks for "http" alone.
    guard = _contains_any(low, ("http", "www.", *SITE_ENDS))
    return guard & col.rlike(f"(?iu){starts}|(?:{ends}){WORD_END}")


def has_at_or_hash(col: Column) -> Column:
    return col.contains("@") | col.contains("#")


def has_bare_http(col: Column, low: Column | None = None) -> Column:
    low = F.lower(col) if low is None else low
    return low.contains("http") & col.rlike(f"(?iu){WORD_START}http{WORD_END}")


def has_emoji(col: Column) -> Column:
    """Some emoji; a text of single-byte characters has none."""
    spans = "".join(rf"\x{{{lo:x}}}-\x{{{hi:x}}}" for lo, hi in EMOJI)
    return (F.octet_length(col) != F.char_length(col)) & col.rlike(f"[{spans}]")


def has_noise(col: Column, low: Column | None = None) -> Column:
    """URL, symbol, bare ``http`` or emoji; the cheapest test runs first."""
    return has_at_or_hash(col) | has_url(col, low) | has_bare_http(col, low) | has_emoji(col)


def has_marker(
    col: Column, terms: Iterable[Sequence[str]] = MARKERS, low: Column | None = None
) -> Column:
    """Some term stands as a word of its own; its parts may be spaced apart."""
    terms = [tuple(t) for t in terms]
    choices = "|".join(f"[{SPACE}]*".join(map(re.escape, term)) for term in terms)
    found = col.rlike(f"(?iu){WORD_START}(?:{choices}){WORD_END}")
    runs = [[r for part in term for r in _TWO_CASED.findall(part.lower())] for term in terms]
    if not all(runs):
        return found
    low = F.lower(col) if low is None else low
    return _contains_any(low, (max(r, key=len) for r in runs)) & found


@dataclass(frozen=True)
class RuleSet:
    """Parameters of the cleaning rules."""

    min_words: int = 3
    digits: str = DIGITS
    markers: tuple[tuple[str, ...], ...] = MARKERS


# Rule codes in the order they are applied; 0 means the pair is kept.
KEPT, SHORT, MIXED_DIGITS, NOISE, MARKER = range(5)
RULE_NAMES = {
    SHORT: "short",
    MIXED_DIGITS: "mixed_digits",
    NOISE: "noise",
    MARKER: "marker",
}


def first_failing_rule(
    src: Column, tgt: Column, src_low: Column, tgt_low: Column, rules: RuleSet = RuleSet()
) -> Column:
    """Code of the first rule the pair fails. Later rules are not evaluated."""
    long_enough = has_min_words(src, rules.min_words) & has_min_words(tgt, rules.min_words)
    noise = has_noise(src, src_low) | has_noise(tgt, tgt_low)
    marker = has_marker(src, rules.markers, src_low) | has_marker(tgt, rules.markers, tgt_low)
    return (
        F.when(~F.coalesce(long_enough, F.lit(False)), SHORT)  # a null side is short
        .when(has_mixed_digits(tgt, rules.digits), MIXED_DIGITS)
        .when(noise, NOISE)
        .when(marker, MARKER)
        .otherwise(KEPT)
    )
