"""Sharding by extendible hashing, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinline.operators.prefix import running_sums
from twinline.session import store

HASH_BITS = 60
STEP = 15  # levels settled at once; the first step has at most 2^15 cells
SPAN = 4096


def key_hash(key: Column) -> Column:
    """The first 60 bits of the MD5 of the key as text; null counts as empty."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def _prefix(bits: int, of: str = "_h") -> Column:
    return F.shiftright(F.col(of), HASH_BITS - bits)


def _settle(rows: DataFrame, low: int, high: int, limit: int) -> DataFrame:
    """``_cell, _depth``: for each ``high``-bit cell the least depth whose bucket fits, null if none does."""
    cells = rows.groupBy(_prefix(high).alias("_cell")).agg(F.sum("_n").alias("_n"))
    levels = cells.select("_cell", "_n", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("_l"))
    levels = levels.withColumn("_p", F.expr(f"shiftright(_cell, {high} - _l)"))
    totals = levels.groupBy("_l", "_p").agg(F.sum("_n").alias("_total"))
    fits = totals.filter(F.col("_total") <= limit).select(F.col("_l").alias("_fl"), F.col("_p").alias("_fp"))
    found = levels.join(fits, (F.col("_l") == F.col("_fl")) & (F.col("_p") == F.col("_fp")), "left")
    return found.groupBy("_cell").agg(F.min("_fl").cast("int").alias("_depth"))


def assign_shards(docs: DataFrame, key: str = "doc_id", size: Column | None = None, limit: int = 1 << 20) -> DataFrame:
    """``docs`` with ``shard`` (string), ``shard_depth`` (int) and ``shard_row_bytes`` (long).

    A shard is a bucket of the directory, named by the hash bits that its keys share; only buckets beyond
    ``limit`` bytes are split on another bit. Sizes default to the UTF-8 bytes of ``text``, null as 0.
    A row larger than the limit is a shard of its own, ``!`` and its number under its hash. Keys that agree in
    all 60 bits cannot be split by bits: their rows fill overflow pages of at most half the limit and one more row
    of at most half, ``+`` and the page; so repeated keys, also a third of all rows, never make a shard too large.
    Bucket sizes are summed in the tasks before any shuffle. Rows themselves move only for cells deeper than 15
    bits. Clashing column names are refused; an empty table gives no row.
    """
    clash = {"shard", "shard_depth", "shard_row_bytes"} & set(docs.columns) | {c for c in docs.columns if c.startswith("_")}
    if clash:
        raise ValueError(f"columns clash: {sorted(clash)}")
    size = F.coalesce(F.octet_length("text"), F.lit(0)) if size is None else F.coalesce(size, F.lit(0))
    rows = docs.withColumn("_h", key_hash(F.col(key))).withColumn("_n", size.cast("long"))
    narrow = rows.select("_h", "_n").filter(F.col("_n") <= limit)
    depth, open_rows, at, is_open = F.lit(None).cast("int"), narrow, 0, True
    while at < HASH_BITS and is_open:
        high = at + STEP
        settled, _ = store(_settle(open_rows, at, high, limit), "directory")
        cell, found = f"_cell{high}", f"_depth{high}"
        settled = settled.withColumnsRenamed({"_cell": cell, "_depth": found})
        # The first step has at most 32,768 cells; later ones grow with the data and are joined.
        side = F.broadcast(settled) if at == 0 else settled
        rows = rows.join(side, (_prefix(high) == F.col(cell)) & (F.col("_n") <= limit), "left").drop(cell)
        depth = F.coalesce(depth, F.col(found))
        left = settled.filter(F.col(found).isNull()).select(cell)
        is_open = not left.isEmpty()
        open_rows = open_rows.join(left, _prefix(high) == F.col(cell), "left_semi")
        at = high
    rows = rows.withColumn("_depth", depth)
    bits = F.when(F.col("_depth") == 0, "").otherwise(
        F.expr(f"lpad(conv(shiftright(_h, {HASH_BITS} - _depth), 10, 2), _depth, '0')")
    )
    name = lambda mark, number: F.concat(F.lpad(F.conv(F.col("_h"), 10, 2), HASH_BITS, "0"), F.lit(mark), number.cast("string"))
    fits = rows.filter(F.col("_depth").isNotNull()).withColumn("shard", bits)
    rest = rows.filter(F.col("_depth").isNull()).withColumn("_row", F.monotonically_increasing_id())
    half = limit // 2
    rest = rest.withColumn("_alone", (F.col("_n") > half).cast("int"))
    rest = rest.withColumn("_share", F.when(F.col("_alone") == 1, 1).otherwise(F.col("_n")))
    rest = running_sums(rest, ["_h", "_alone"], "_row", {"_end": "_share"}, SPAN)
    page = F.floor((F.col("_end") - F.col("_share")) / F.lit(max(half, 1)))
    rest = rest.withColumn("_depth", F.lit(HASH_BITS)).withColumn(
        "shard", F.when(F.col("_alone") == 1, name("!", F.col("_end") - 1)).otherwise(name("+", page))
    )
    columns = [*docs.columns, "shard", F.col("_depth").alias("shard_depth"), F.col("_n").alias("shard_row_bytes")]
    return fits.select(*columns).unionByName(rest.select(*columns))
