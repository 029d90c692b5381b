"""The stateless part of cleaning, for streams of pairs.

Duplicates need every earlier pair and so stay a batch job.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinline.functions.rules import KEPT, RuleSet
from twinline.operators.clean import nonempty_pairs, normalize_pairs, tag_pairs


def clean_stream(pairs: DataFrame, rules: RuleSet = RuleSet()) -> DataFrame:
    """Stripped, non-empty pairs that pass every rule."""
    usable = normalize_pairs(nonempty_pairs(pairs))
    return tag_pairs(usable, rules).filter(F.col("rule") == KEPT).drop("rule")


def run_clean_stream(
    spark: SparkSession, source: str, schema: str, to_pairs: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str,
    rules: RuleSet = RuleSet(), files_at_once: int = 64,
) -> int:
    """Clean what has come to ``source`` since the last run into ``sink``; gives the number of batches.

    The checkpoint holds which files are done and the sink's log which outputs count, so a run that was stopped goes on
    without repeats, and a run without new files does nothing.
    """
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(source)
    query = (
        clean_stream(to_pairs(rows), rules)
        .writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(sink)
    )
    query.awaitTermination()
    return len([p for p in query.recentProgress if p["numInputRows"] > 0])
