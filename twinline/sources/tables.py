"""Pair sources: tables and CSV files with a fixed schema."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinline.functions.text import is_filled, strip

_BAD = "_bad"

# A quote inside a field is doubled; fields may hold line ends; nothing is trimmed.
CSV_FORMAT = {
    "header": "true",
    "quote": '"',
    "escape": '"',
    "multiLine": "true",
    "encoding": "UTF-8",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


def scan_table(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Parquet scan with a declared schema."""
    return spark.read.schema(schema).parquet(path)


def string_schema(columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def scan_csv(
    spark: SparkSession, path: str, columns: list[str], partitions: tuple[str, ...] = (), **options: str
) -> DataFrame:
    """Headered CSV scan of ``columns`` by name. Every cell is a string; malformed rows carry ``_bad``.

    The header of the first file gives the order; a file with another header, or a column that the header
    lacks, is an error. Without a header ``columns`` is the order. ``partitions`` names columns that come from folder names.
    """
    settings = {**CSV_FORMAT, **options}
    header = list(columns)
    if str(settings["header"]).lower() == "true":
        try:
            found = spark.read.options(**settings).option("inferSchema", "false").csv(path).columns
        except AnalysisException as e:
            if e.getCondition() != "UNABLE_TO_INFER_SCHEMA":
                raise
            found = header  # a folder without any file has no rows
        header = [c for c in found if c not in partitions]
    missing = [c for c in columns if c not in header]
    if missing:
        raise ValueError(f"the header {header} lacks {missing}")
    scanned = (
        spark.read.schema(string_schema([*header, _BAD, *partitions]))
        .options(**settings)
        .option("mode", "PERMISSIVE")
        .option("enforceSchema", "false")
        .option("columnNameOfCorruptRecord", _BAD)
        # Column pruning in the CSV parser would hide rows with surplus fields.
        .option("columnPruning", "false")
        .csv(path)
    )
    # Always true: Spark refuses a query, such as a count, that uses no field but ``_bad``.
    whole = scanned.filter(F.coalesce(F.length(header[0]), F.lit(0)) >= 0)
    return whole.select(*columns, _BAD, *partitions)


def read_pairs_csv(
    spark: SparkSession, path: str, columns: list[str], required: list[str] | None = None,
    partitions: tuple[str, ...] = (), **options: str,
) -> DataFrame:
    """Well-formed rows, stripped, with every ``required`` column filled (default: all)."""
    good, _ = quarantine(scan_csv(spark, path, columns, partitions, **options))
    for c in columns if required is None else required:
        good = good.filter(is_filled(F.col(c)))
    return good.select(*partitions, *[strip(F.col(c)).alias(c) for c in columns])


def quarantine(scanned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split a CSV scan into well-formed rows and malformed ones.

    The malformed keep their ``raw`` text beside the fields that could be read.
    """
    good = scanned.filter(F.col(_BAD).isNull()).drop(_BAD)
    bad = scanned.filter(F.col(_BAD).isNotNull()).withColumnRenamed(_BAD, "raw")
    return good, bad


REASONS = ("well formed", "empty", "too many fields", "too few fields")


def malformed_reason(scanned: DataFrame) -> Column:
    """Which of :data:`REASONS` fits a row of a CSV scan."""
    named = [c for c in scanned.columns if c != _BAD]
    filled = sum((F.col(c).isNotNull().cast("int") for c in named), F.lit(0))
    return (
        F.when(F.col(_BAD).isNull(), "well formed")
        .when(F.trim(_BAD) == "", "empty")
        .when(filled == len(named), "too many fields")
        .otherwise("too few fields")
    )


def malformed_counts(scanned: DataFrame) -> DataFrame:
    """Rows of a CSV scan by ``reason``: well formed, too few fields, too many, or empty."""
    return scanned.groupBy(malformed_reason(scanned).alias("reason")).agg(F.count("*").alias("n_rows"))


def write_quarantined(scanned: DataFrame, path: str) -> dict[str, int]:
    """Write good and bad rows of a CSV scan to folders of ``path``, and count them by reason, in one pass.

    The folder is partitioned by ``outcome``; bad rows keep their ``raw`` text. The counts are observed while the rows are
    written, so neither the source nor the sink is read for them.
    """
    seen = Observation("outcome of a scan")
    counts = [F.count_if(F.col("reason") == r).alias(r) for r in REASONS]
    tagged = scanned.withColumn("reason", malformed_reason(scanned)).withColumnRenamed(_BAD, "raw").observe(seen, *counts)
    outcome = F.when(F.col("raw").isNull(), "good").otherwise("bad")
    tagged.withColumn("outcome", outcome).write.partitionBy("outcome").parquet(path)
    return dict(seen.get)
