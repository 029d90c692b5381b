"""Summaries of a training-loss log (run, epoch, step, loss)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinline.operators.prefix import running_sums


def epoch_loss(log: DataFrame) -> DataFrame:
    """Mean loss of each epoch."""
    return log.groupBy("run", "epoch").agg(
        F.avg("loss").alias("avg_loss"), F.count("*").alias("n_batches")
    )


def val_loss(log: DataFrame) -> DataFrame:
    """Mean of the batch means: every batch weighs the same, whatever its size."""
    batches = log.groupBy("run", "epoch", "batch").agg(F.avg("loss").alias("loss"))
    return batches.groupBy("run", "epoch").agg(
        F.avg("loss").alias("avg_val_loss"), F.count("*").alias("n_batches")
    )


def running_loss(log: DataFrame, every: int, span: int = 100_000) -> DataFrame:
    """Mean loss so far in the epoch, at each step that is a multiple of ``every``.

    ``step`` is unique in its epoch and counts from 1. Steps between two reports are summed before the
    shuffle, which shrinks it ``every``-fold; the running sum then works on the reports.
    """
    at_report = F.col("step") % every == 0
    reports = log.groupBy("run", "epoch", F.ceil(F.col("step") / every).alias("report")).agg(
        F.sum("loss").alias("_sum"),
        F.count("loss").alias("_n"),
        F.max(F.when(at_report, F.col("loss"))).alias("loss"),
        F.max(at_report).alias("_reported"),
    )
    summed = running_sums(reports, ["run", "epoch"], "report", {"_sums": "_sum", "_ns": "_n"}, span)
    return summed.filter("_reported").select(
        "run",
        "epoch",
        (F.col("report") * every).alias("step"),
        "loss",
        (F.col("_sums") / F.col("_ns")).alias("running_avg"),
    )


def best_checkpoint(epochs: DataFrame, loss: str, keep_last_tie: bool = False) -> DataFrame:
    """Epoch of the lowest loss by run: the first of equal ones, or the last."""
    order = -F.col("epoch") if keep_last_tie else F.col("epoch")
    usable = epochs.filter(F.col(loss).isNotNull() & ~F.isnan(loss))
    best = usable.groupBy("run").agg(F.min(F.struct(F.col(loss).alias("loss"), order.alias("o"))).alias("b"))
    epoch = -F.col("b.o") if keep_last_tie else F.col("b.o")
    return best.select("run", epoch.alias("best_epoch"), F.col("b.loss").alias("best_loss"))


def latest_checkpoint(epochs: DataFrame, limit: int) -> DataFrame:
    """Highest epoch up to ``limit`` by run: where a stopped run resumes."""
    return (
        epochs.filter(F.col("epoch").between(1, limit))
        .groupBy("run")
        .agg(F.max("epoch").alias("resume_epoch"))
    )
