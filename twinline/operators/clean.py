"""Normalization, case-insensitive de-duplication and the cleaning funnel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinline.functions.rules import KEPT, RULE_NAMES, RuleSet, first_failing_rule
from twinline.functions.text import is_filled, strip


def normalize_pairs(
    df: DataFrame, src: str = "src", tgt: str = "tgt", keep: tuple[str, ...] = ("ord",)
) -> DataFrame:
    """Rename both sides, cast them to string and strip them. Nulls stay null."""
    return df.select(*keep, strip(F.col(src)).alias("src"), strip(F.col(tgt)).alias("tgt"))


def nonempty_pairs(df: DataFrame, src: str = "src", tgt: str = "tgt") -> DataFrame:
    """Pairs with text on both sides."""
    return df.filter(is_filled(F.col(src)) & is_filled(F.col(tgt)))


def _with_lower(df: DataFrame) -> DataFrame:
    # Through a generator, because a filter would be pushed through a projection, and with
    # it a copy of every text expression for each mention in the rules.
    texts = F.struct(
        "src", "tgt", F.lower("src").alias("_src_low"), F.lower("tgt").alias("_tgt_low")
    )
    others = [c for c in df.columns if c not in ("src", "tgt")]
    return df.select(*others, F.inline(F.array(texts)))


def pair_key(src_low: Column, tgt_low: Column) -> Column:
    """32-byte digest of a lower-cased pair; the length prefix keeps the sides apart."""
    size = F.octet_length(src_low).cast("string")
    return F.unhex(F.sha2(F.concat(size, F.lit(":"), src_low, tgt_low), 256))


def _first_copies(df: DataFrame, *aggs: Column) -> DataFrame:
    # Only fixed-width buffers, so both phases are hash aggregates and copies of one
    # pair collapse before the shuffle. No text is shuffled.
    return (
        df.withColumn("_key", pair_key(F.col("_src_low"), F.col("_tgt_low")))
        .groupBy("_key")
        .agg(F.min("ord").alias("ord"), F.count("*").alias("n_copies"), *aggs)
    )


def dedup_pairs(df: DataFrame) -> DataFrame:
    """The first copy (lowest ``ord``) of each lower-cased pair, in its own case.

    ``ord`` must be unique. Adds ``n_copies``. Pairs with a null or empty side are dropped first.
    """
    df = nonempty_pairs(df)
    first = _first_copies(_with_lower(df)).select("ord", "n_copies")
    return df.join(first, "ord")


def tag_pairs(df: DataFrame, rules: RuleSet = RuleSet()) -> DataFrame:
    """Add ``rule``: the code of the first failing rule, 0 for none. Also works on streams."""
    return _tagged(df, rules).select(*df.columns, "rule")


def _tagged(df: DataFrame, rules: RuleSet) -> DataFrame:
    texts = [F.col(c) for c in ("src", "tgt", "_src_low", "_tgt_low")]
    return _with_lower(df).withColumn("rule", first_failing_rule(*texts, rules))


def clean_pairs(df: DataFrame, rules: RuleSet = RuleSet()) -> DataFrame:
    """De-duplicate, then keep the survivors that pass every rule.

    A survivor's text is the row's own, so rows that fail are dropped before the join. Pairs with a null or
    empty side are no pairs.
    """
    df = nonempty_pairs(df)
    passing = tag_pairs(df, rules).filter(F.col("rule") == KEPT).drop("rule")
    return passing.join(_first_copies(_with_lower(df)).select("ord"), "ord", "left_semi")


def cleaning_funnel(df: DataFrame, rules: RuleSet = RuleSet()) -> DataFrame:
    """Pairs removed and left at each step, with shares of the original count.

    Step 0 is the input with text on both sides, step 1 the duplicates, then one step per rule, and last the total.
    """
    df = nonempty_pairs(df)
    survivors = _first_copies(_tagged(df, rules), F.min_by("rule", "ord").alias("rule"))
    counts = survivors.agg(
        F.coalesce(F.sum("n_copies"), F.lit(0)).alias("original"),
        F.coalesce(F.sum(F.col("n_copies") - 1), F.lit(0)).alias("duplicate"),
        *[F.count_if(F.col("rule") == code).alias(name) for code, name in RULE_NAMES.items()],
    )
    names = ["duplicate", *RULE_NAMES.values()]
    removed_so_far = F.lit(0).cast("long")
    steps = [_step(0, "original", F.lit(0).cast("long"), F.col("original"))]
    for i, name in enumerate(names, 1):
        removed_so_far = removed_so_far + F.col(name)
        steps.append(_step(i, name, F.col(name), F.col("original") - removed_so_far))
    steps.append(
        _step(len(names) + 1, "total", removed_so_far, F.col("original") - removed_so_far)
    )
    share = lambda c: F.round(100.0 * F.col(c) / F.nullif(F.col("original"), F.lit(0)), 1)
    return counts.select("original", F.inline(F.array(*steps))).select(
        "step",
        "rule",
        "removed",
        share("removed").alias("removed_pct"),
        "remaining",
        share("remaining").alias("remaining_pct"),
    )


def _step(i: int, name: str, removed: Column, remaining: Column) -> Column:
    return F.struct(
        F.lit(i).alias("step"),
        F.lit(name).alias("rule"),
        removed.alias("removed"),
        remaining.alias("remaining"),
    )
