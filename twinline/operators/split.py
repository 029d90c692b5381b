"""Positional train / validation / test split by category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinline.functions.text import is_filled, strip
from twinline.operators.clean import pair_key
from twinline.session import materialize, small_side

# Rows taken from each category, in order of position.
PER_CATEGORY = (("train", 8), ("val", 1), ("test", 1))
SPLIT_SIZE = sum(n for _, n in PER_CATEGORY)


def _usable(df: DataFrame) -> DataFrame:
    filled = [is_filled(F.col(c)) for c in ("category", "src", "tgt")]
    # The category of a group has no white space at its ends.
    return df.filter(filled[0] & filled[1] & filled[2]).withColumn("category", strip(F.col("category")))


def _label(position: Column) -> Column:
    label, end = None, 0
    for name, n in PER_CATEGORY:
        end += n
        label = F.when(position <= end, name) if label is None else label.when(position <= end, name)
    return label


def split_positions(df: DataFrame) -> DataFrame:
    """``ord, category, position, split`` of the rows a split takes.

    Only (category, ord) is ranked, and the group limit keeps ten rows per category and
    task before the shuffle, however large a category is.
    """
    ranked = Window.partitionBy("category").orderBy("ord")
    return (
        _usable(df)
        .select("category", "ord")
        .withColumn("position", F.row_number().over(ranked))
        .filter(F.col("position") <= SPLIT_SIZE)
        .withColumn("_n", F.count("*").over(Window.partitionBy("category")))
        .filter(F.col("_n") == SPLIT_SIZE)
        .select("ord", "category", "position", _label(F.col("position")).alias("split"))
    )


def stratified_split(df: DataFrame) -> DataFrame:
    """First rows of each category by ``ord``: 8 train, 1 val, 1 test.

    Categories with fewer rows are left out whole; rows past the tenth are unused. The
    few winners fetch their text by ``ord``, unique in the table, so no other text moves.
    """
    heads = small_side(split_positions(df).drop("category"), "heads")
    return df.join(heads, "ord").select("split", strip(F.col("category")).alias("category"), "position", "ord", "src", "tgt")


def category_report(df: DataFrame) -> DataFrame:
    """Rows of each category, how many a split leaves unused, and whether it is skipped."""
    counts = _usable(df).groupBy("category").agg(F.count("*").alias("n_pairs"))
    skipped = F.col("n_pairs") < SPLIT_SIZE
    return counts.select(
        "category",
        "n_pairs",
        skipped.alias("skipped"),
        F.when(skipped, F.col("n_pairs")).otherwise(F.col("n_pairs") - SPLIT_SIZE).alias("n_unused"),
    )


def skipped_categories(df: DataFrame) -> DataFrame:
    """Categories too small to split."""
    return category_report(df).filter("skipped").select("category", "n_pairs")


def split_report(df: DataFrame) -> DataFrame:
    """Pairs and categories of each split, from the ranked positions alone."""
    return (
        split_positions(df)
        .groupBy("split")
        .agg(F.count("*").alias("n_pairs"), F.count_distinct("category").alias("n_categories"))
    )


def split_leakage(splits: DataFrame) -> DataFrame:
    """Test rows that also occur in train, by lower-cased source and by pair."""
    low = [F.lower(F.col(c)).alias(f"{c}_low") for c in ("src", "tgt")]
    train = splits.filter(F.col("split") == "train").select(*low)
    test = splits.filter(F.col("split") == "test").select("ord", *low)
    by_src = test.join(train.select("src_low"), "src_low", "left_semi").select("ord")
    by_pair = test.join(train, ["src_low", "tgt_low"], "left_semi").select("ord")
    checks = (("test", test.select("ord")), ("in_train_by_src", by_src), ("in_train_by_pair", by_pair))
    tagged = None
    for name, rows in checks:
        one = rows.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("check"), "n_rows")
        tagged = one if tagged is None else tagged.unionByName(one)
    return tagged


def leak_report(splits: DataFrame, corpora: dict[str, DataFrame]) -> DataFrame:
    """How many held-out rows occur in each corpus: ``corpus, split, by, n_held_out, n_found``.

    ``by`` is the lower-cased source or the whole pair. The held-out keys are few: they go to the corpora, which are read
    once each and not moved; only keys that are found come back. Null sides never match.
    """
    by_src = F.unhex(F.sha2(F.lower("src"), 256))
    by_pair = pair_key(F.lower("src"), F.lower("tgt"))
    keyed = F.inline(F.array(*[F.struct(F.lit(n).alias("by"), k.alias("key")) for n, k in (("src", by_src), ("pair", by_pair))]))
    held = materialize(splits.filter("split <> 'train'").select("split", "ord", keyed), "held-out")
    known = small_side(held.select("by", "key").distinct(), "held-out-keys")
    found = None
    for name, pairs in corpora.items():
        one = pairs.select(keyed).join(known, ["by", "key"], "left_semi").distinct().withColumn("corpus", F.lit(name))
        found = one if found is None else found.unionByName(one)
    names = F.explode(F.array(*[F.lit(n) for n in corpora])).alias("corpus")
    all_rows = held.select("split", "by", "key", names)
    marked = all_rows.join(found.withColumn("_found", F.lit(True)), ["corpus", "by", "key"], "left")
    return marked.groupBy("corpus", "split", "by").agg(
        F.count("*").alias("n_held_out"), F.count_if("_found").alias("n_found")
    )
