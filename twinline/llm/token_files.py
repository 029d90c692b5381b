"""Token ids as Parquet lists: small row groups, dictionary or delta pages, page indexes, documents in id order."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinline.llm.tokens import encode_whole, slices
from twinline.session import small_side

FILE_SCHEMA = "doc_id long, part int, part_start long, n_tokens long, ids array<int>"

# Version 2 pages: ids in a dictionary (a vocabulary's ids fit one page), numbers that rise as deltas.
FORMAT = {
    "compression": "zstd",
    "parquet.writer.version": "v2",
    "parquet.enable.dictionary": "false",
    "parquet.enable.dictionary#ids.list.element": "true",
    "parquet.page.row.count.limit": "512",
}


def write_token_files(
    docs: DataFrame, path: str, tokenizer: str, end_id: int, doc_id: str = "doc_id", text: str = "text",
    row_group_bytes: int = 16 << 20, page_bytes: int = 256 << 10,
) -> None:
    """Encode each whole text, append ``end_id``, and write files whose rows ascend by document id.

    Null texts are empty; rows without an id come first; rows that share an id all stay, in any order.
    Ranges are cut by (id, place of the row), so one id with very many rows is spread too. ``part`` is
    the writing task, ``part_start`` the ids before the document in that task. Page indexes let a reader
    that filters on ``doc_id`` skip pages; ``n_tokens`` is read without the ids.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = rows.withColumn("_place", F.monotonically_increasing_id())
    ordered = rows.repartitionByRange("doc_id", "_place").sortWithinPartitions("doc_id", "_place")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            for s in slices(batch, "text"):
                ids, counts = encode_whole(s.column("text"), tokenizer, end_id)
                cuts = np.concatenate(([0], np.cumsum(counts)))
                yield pa.RecordBatch.from_arrays(
                    [
                        s.column("doc_id"),
                        pa.array(np.full(len(counts), part, np.int32)),
                        pa.array(before + cuts[:-1]),
                        pa.array(counts),
                        pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(ids.view(np.int32))),
                    ],
                    names=["doc_id", "part", "part_start", "n_tokens", "ids"],
                )
                before += int(cuts[-1])

    out = ordered.drop("_place").mapInArrow(encode, FILE_SCHEMA)
    sizes = {"parquet.block.size": str(row_group_bytes), "parquet.page.size": str(page_bytes)}
    out.write.options(**FORMAT, **sizes).parquet(path)


def read_token_files(
    spark: SparkSession, path: str, columns: list[str] | None = None, where: Column | None = None
) -> DataFrame:
    """The files, with only the asked columns and pages read; ``start`` is the ids before the document in all files."""
    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    # One row a file: the only place where all parts meet.
    before = totals.select(
        F.col("part").alias("_part"), F.expr("coalesce(sum(n) over (order by part rows between unbounded preceding and 1 preceding), 0)").alias("_before")
    )
    rows = files if where is None else files.filter(where)
    found = rows.join(small_side(before, "file-starts"), F.col("part") == F.col("_part")).withColumn("start", F.col("_before") + F.col("part_start"))
    return found.select(*(columns or ["doc_id", "start", "n_tokens", "ids"]))


def crc_of_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``doc_id, start, n_tokens, ids`` to the checksum of each document's ids."""
    for b in batches:
        lists = b.column("ids")
        flat = lists.values.to_numpy(zero_copy_only=False).astype("<u4")
        at = lists.offsets.to_numpy()
        crc = [zlib.crc32(flat[i:j].data) for i, j in zip(at[:-1], at[1:])]
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("start"), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())],
            names=["doc_id", "start", "n_tokens", "ids_crc32"],
        )
