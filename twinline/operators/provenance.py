"""Field-session provenance: counts by category and source, consent exclusion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinline.session import small_side


def provenance_rollup(pairs: DataFrame) -> DataFrame:
    """Pairs by (category, source), by category, and in all; null marks a total."""
    return pairs.rollup("category", "source").agg(
        F.grouping_id().cast("int").alias("level"), F.count("*").alias("n_pairs")
    )


def consent_filter(pairs: DataFrame, sessions: DataFrame, keep_unlogged: bool = True) -> DataFrame:
    """Pairs whose session gave consent; an unknown consent is none.

    Pairs of sessions outside the log stay only with ``keep_unlogged``.

    The list of withheld sessions is broadcast if its counted size allows: one session may
    hold much of the corpus, and its pairs then stay where they are.
    """
    given = F.coalesce(F.col("consent"), F.lit(False))
    if not keep_unlogged:
        # A session logged more than once must have agreed each time.
        agreed = sessions.groupBy("session_id").agg(F.every(given).alias("_all")).filter("_all").select("session_id")
        return pairs.join(small_side(agreed, "agreed"), "session_id", "left_semi")
    withheld = sessions.filter(~given).select("session_id").distinct()
    return pairs.join(small_side(withheld, "withheld"), "session_id", "left_anti")
