"""Running totals and global positions without a single-task window."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def running_sums(
    df: DataFrame, groups: list[str], order: str, sums: Mapping[str, str], span: int
) -> DataFrame:
    """Add, for each ``{output: input}``, the running sum of ``input`` along ``order``.

    A group is cut into chunks of ``span`` order values. Windows run inside a chunk; the
    chunk totals, one row each, carry the sum across chunks. So a group that holds
    most of the rows is still spread over many tasks. ``order`` is a unique integer in
    each group.
    """
    chunked = df.withColumn("_chunk", F.floor(F.col(order) / span))
    totals = chunked.groupBy(*groups, "_chunk").agg(
        *[F.sum(c).alias(f"_sum_{out}") for out, c in sums.items()]
    )
    before = Window.partitionBy(*groups).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(g).alias(f"_g_{g}") for g in groups],
        F.col("_chunk").alias("_g_chunk"),
        *[F.coalesce(F.sum(f"_sum_{o}").over(before), F.lit(0)).alias(f"_before_{o}") for o in sums],
    )
    matched = F.col("_chunk") == F.col("_g_chunk")
    for g in groups:
        matched = matched & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    inside = (
        Window.partitionBy(*groups, "_chunk")
        .orderBy(order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    out = chunked.join(offsets, matched)
    out = out.select(
        *df.columns,
        *[(F.sum(c).over(inside) + F.col(f"_before_{o}")).alias(o) for o, c in sums.items()],
    )
    return out


def bucket_sizes(df: DataFrame, bucket: str) -> DataFrame:
    return df.groupBy(bucket).agg(F.count("*").alias("_n"))


def global_index(
    df: DataFrame, sizes: DataFrame, bucket: str, order: list[str], name: str, span: int = 4096
) -> DataFrame:
    """Add the 0-based global position of each row under (``bucket``, ``order``).

    ``bucket`` is an integer that never falls along the order, ``sizes`` its row counts. Rows
    are numbered inside their bucket and shifted by the rows of earlier buckets, so no task
    sees all rows.
    """
    ends = running_sums(sizes.withColumn("_all", F.lit(0)), ["_all"], bucket, {"_end": "_n"}, span)
    starts = ends.select(F.col(bucket).alias("_b"), (F.col("_end") - F.col("_n")).alias("_start"))
    inside = Window.partitionBy(bucket).orderBy(*order)
    return (
        df.withColumn("_rn", F.row_number().over(inside))
        .join(starts, F.col(bucket) == F.col("_b"))
        .withColumn(name, F.col("_start") + F.col("_rn") - 1)
        .drop("_rn", "_b", "_start")
    )
