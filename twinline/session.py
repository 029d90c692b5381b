"""Session helpers: the shared scratch folder and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CHECKPOINT_CONF = "spark.checkpoint.dir"
_fallback: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder the cluster names; a local one only in local mode, where there is one machine."""
    named = spark.conf.get(_CHECKPOINT_CONF, None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError(f"{_CHECKPOINT_CONF} must name a folder that all executors share")
    if "dir" not in _fallback:
        _fallback["dir"] = tempfile.mkdtemp(prefix="twinline-")
    return _fallback["dir"]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{scratch_root(spark)}/twinline/{label}-{uuid.uuid4().hex}"


def store(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder and read it back; also gives the path.

    Cuts the lineage once, computes once, and survives lost executors.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """:func:`store` for a table that is kept for the session."""
    return store(df, label)[0]


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target))


def discard(spark: SparkSession, path: str) -> None:
    """Delete a stored table that nothing reads any more."""
    if f"{scratch_root(spark)}/twinline/" not in path:
        raise ValueError(f"not a stored table: {path}")
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def small_side(df: DataFrame, label: str, max_bytes: int = 32 << 20) -> DataFrame:
    """``df`` computed once, and marked for broadcast if its values have at most ``max_bytes``.

    Strings count by their bytes, other values as eight. A larger table is left to a shuffled join.
    """
    stored = materialize(df, label)
    kinds = dict(stored.dtypes)
    width = sum((F.coalesce(F.octet_length(c), F.lit(0)) if k == "string" else F.lit(8) for c, k in kinds.items()), F.lit(0))
    size = stored.agg(F.sum(width.cast("long")).alias("size")).first()["size"] or 0
    return F.broadcast(stored) if size <= max_bytes else stored
