"""Sinks: quoted CSV, split folders, line corpus, and a report of what was written."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from twinline.functions.text import is_filled
from twinline.sources.tables import CSV_FORMAT, scan_csv

# Quoted line ends make a CSV file unsplittable, so files are kept small enough for one task.
ROWS_PER_FILE = 500_000


def _csv_options(quote_all: bool) -> dict[str, str]:
    options = {k: v for k, v in CSV_FORMAT.items() if k != "multiLine"}
    return {**options, "quoteAll": str(quote_all).lower(), "lineSep": "\n"}


def write_clean(df: DataFrame, path: str, rows_per_file: int = ROWS_PER_FILE) -> int:
    """CSV with a header and every field quoted; gives the rows, counted while they are written."""
    seen = Observation("rows of a sink")
    (
        df.observe(seen, F.count(F.lit(1)).alias("n_rows"))
        .write.options(**_csv_options(quote_all=True))
        .option("maxRecordsPerFile", rows_per_file)
        .csv(path)
    )
    return seen.get["n_rows"]


def write_splits(df: DataFrame, path: str, rows_per_file: int = ROWS_PER_FILE) -> None:
    """One folder per split, so that a reader of one split scans only its files."""
    (
        df.write.partitionBy("split")
        .options(**_csv_options(quote_all=False))
        .option("maxRecordsPerFile", rows_per_file)
        .csv(path)
    )


def write_corpus(df: DataFrame, path: str, column: str = "text") -> None:
    """Plain text, one sentence a line; empty sentences are left out."""
    df.filter(is_filled(F.col(column))).select(column).write.option("lineSep", "\n").text(path)


def write_feed(df: DataFrame, path: str) -> None:
    """Parquet in batch order: the rows of a batch lie together in one file."""
    df.repartitionByRange("batch_id").sortWithinPartitions("batch_id", "pos").write.parquet(path)


def sink_report(spark: SparkSession, path: str, columns: list[str], n_rows: int | None = None) -> DataFrame:
    """Rows of a CSV folder, its files and their bytes. Rows are read back unless the sink's count is given."""
    # Without its content column the binary source lists files and reads none of them.
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(path)
    rows = scan_csv(spark, path, columns).agg(F.count("*")).scalar() if n_rows is None else F.lit(n_rows).cast("long")
    size = F.coalesce(F.sum("length"), F.lit(0))
    return files.agg(
        rows.alias("n_rows"),
        F.count("*").alias("n_files"),
        size.alias("n_bytes"),
        F.round(size / 1024, 1).alias("size_kb"),
    )
