"""Weighted source mix, seeded shuffle and batch assignment."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinline.operators.prefix import bucket_sizes, global_index
from twinline.session import materialize


def stack_sources(sources: Mapping[str, DataFrame], columns: list[str]) -> DataFrame:
    """Union of the named sources with a ``source`` column."""
    parts = [df.select(F.lit(name).alias("source"), *columns) for name, df in sources.items()]
    return reduce(DataFrame.unionByName, parts)


def _repeats(weights: Mapping[str, int]) -> Column:
    pairs = chain.from_iterable((F.lit(k), F.lit(int(v))) for k, v in weights.items())
    return F.coalesce(F.element_at(F.create_map(*pairs), F.col("source")), F.lit(0))


def weighted_mix(df: DataFrame, weights: Mapping[str, int]) -> DataFrame:
    """Repeat each row as often as its source weighs; unlisted sources are left out.

    Adds ``copy`` (from 1). Keep rows narrow here: every column is multiplied.
    """
    kept = df.withColumn("_w", _repeats(weights)).filter(F.col("_w") > 0)
    return kept.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_w")))).drop("_w")


def mix_report(df: DataFrame, weights: Mapping[str, int]) -> DataFrame:
    """Rows, weight and effective samples by source and in total, without repeating a row."""
    by_source = (
        df.groupBy("source")
        .agg(F.count("*").alias("n_pairs"))
        .withColumn("weight", _repeats(weights))
        .withColumn("n_samples", F.col("n_pairs") * F.col("weight"))
    )
    total = by_source.agg(
        F.coalesce(F.sum("n_pairs"), F.lit(0)).alias("n_pairs"),
        F.coalesce(F.sum("n_samples"), F.lit(0)).alias("n_samples"),
    ).select(
        F.lit("(total)").alias("source"), "n_pairs", F.lit(None).cast("int").alias("weight"), "n_samples"
    )
    return by_source.unionByName(total)


def shuffle_key(seed: int) -> Column:
    """Order of a seeded shuffle; depends on the row alone, never on its partition."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("source"), F.col("ord"), F.col("copy")))


def shuffled_mix(df: DataFrame, seed: int) -> DataFrame:
    """Rows in seeded random order."""
    return df.withColumn("shuffle_key", shuffle_key(seed)).orderBy("shuffle_key", "source", "ord", "copy")


def assign_batches(
    df: DataFrame, batch_size: int, order: str | None = None, seed: int = 0,
    drop_last: bool = True, bucket_hex: int = 4, bucket_span: int = 1_000_000,
) -> DataFrame:
    """Add ``batch_id`` and ``pos``.

    With ``order``, a unique integer column, batches follow it (validation). Without,
    they follow the seeded shuffle (training); the leading hex digits of its key make
    even buckets whatever the source sizes. ``drop_last`` drops an incomplete last batch.
    """
    if order is None:
        keyed = df.withColumn("_key", shuffle_key(seed))
        bucket = F.conv(F.substring("_key", 1, bucket_hex), 16, 10).cast("long")
        by = ["_key", "source", "ord", "copy"]
    else:
        keyed = df
        bucket = F.floor(F.col(order) / bucket_span)
        by = [order]
    bucketed = keyed.withColumn("_bucket", bucket)
    sizes = materialize(bucket_sizes(bucketed, "_bucket"), "buckets")
    out = global_index(bucketed, sizes, "_bucket", by, "_index").select(
        *df.columns,
        F.floor(F.col("_index") / batch_size).alias("batch_id"),
        (F.col("_index") % batch_size).cast("int").alias("pos"),
    )
    if not drop_last:
        return out
    full = sizes.agg(F.floor(F.sum("_n") / batch_size)).scalar()
    return out.filter(F.col("batch_id") < full)


def feed_report(train: DataFrame, val: DataFrame, batch: int, accumulate: int, epochs: int) -> DataFrame:
    """One row: samples, validation samples, full batches an epoch, steps in all, and samples behind one update."""
    counts = [df.agg(F.count("*")).scalar() for df in (train, val)]
    one = train.sparkSession.range(1).select(counts[0].alias("n_samples"), counts[1].alias("n_val_samples"))
    steps = F.floor(F.col("n_samples") / batch)
    return one.select(
        "*", steps.alias("steps_per_epoch"), (steps * epochs).alias("total_steps"), F.lit(batch * accumulate).cast("long").alias("effective_batch")
    )
