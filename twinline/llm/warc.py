"""WARC archives: a deterministic sharded writer and a verifying reader."""

from __future__ import annotations

import hashlib
import posixpath
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pfs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinline.session import discard, store

BINS = 65_536  # equal id ranges whose sizes fix the shards: bounds what is collected and broadcast
_READ = 16 << 10
TASK_SHARDS = 16  # shards that one task writes, one after the other, where shards outnumber four a core
LEAST_REVISIT = 100  # bytes; smaller payloads are always written
DATE = "2024-01-01T00:00:00Z"

FILE_SCHEMA = "temp string, name string, records long, bytes long, sha256 string"
RECORD_SCHEMA = (
    "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, html string"
)


def shard_bins(narrow: DataFrame, shard_bytes: int) -> tuple[int, int, list[tuple]]:
    """Lowest id, bin width, and ``(bin, first shard, shards)`` of each bin: depends on the rows alone, not their order."""
    ends = narrow.agg(F.min("page_id").alias("a"), F.max("page_id").alias("b")).first()
    if ends["a"] is None:
        return 0, 1, []
    low, width = ends["a"], (ends["b"] - ends["a"]) // BINS + 1
    sizes = (
        narrow.groupBy(F.floor((F.col("page_id") - low) / width).alias("bin"))
        .agg(F.sum("n").alias("n"))
        .filter("bin is not null")
        .orderBy("bin")
        .collect()  # at most BINS rows
    )
    out, shard, filled = [], 1, 0
    for r in sizes:
        if filled and filled + r["n"] > shard_bytes:
            shard, filled = shard + 1, 0
        parts = max(1, -(-r["n"] // shard_bytes))
        out.append((r["bin"], shard, parts))
        shard, filled = (shard + parts, 0) if parts > 1 else (shard, filled + r["n"])
    return low, width, out


def _header(kind: str, page_id, url: str, digest: str, block: bytes, refers_to, first_id: str | None) -> bytes:
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {record_id(page_id, digest)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {url}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
    ]
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if kind == "revisit":
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {first_id}",
            f"X-Refers-To-Page-Id: {refers_to}",
        ]
    lines.append(f"Content-Length: {len(block)}")
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}:{digest}')}>"


def make_record(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """One gzip member. A revisit keeps the HTTP head, whose length names the full payload."""
    kind = "response" if refers_to is None else "revisit"
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = head.encode() + (payload if refers_to is None else b"")
    target = "".join((url or "").splitlines())
    first = None if refers_to is None else record_id(refers_to, digest)
    data = _header(kind, page_id, target, digest, block, refers_to, first) + block + b"\r\n\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)  # a gzip head without time or name
    return z.compress(data) + z.flush()


def write_warc(
    pages: DataFrame, path: str, shard_bytes: int = 32 << 20, file_bytes: int = 16 << 20
) -> None:
    """Write ``page_id, url, html`` as gzip WARC files and a manifest below ``path``.

    Payloads are the html in UTF-8, null as empty. Of equal payloads of 100 bytes or more the smallest
    page id is a response and the other ids revisit it. Records ascend by (page id, digest); rows without an
    id come first; rows that share id and payload are all written. Shards are id ranges fixed by the
    sizes of the rows; a bin of ids beyond ``shard_bytes`` is cut by digest. A file ends once it holds
    ``file_bytes`` compressed. Tasks write under names of their own attempt; then finished files are renamed, and the
    manifest, written last, commits them: readers see only what it lists. Ids, digests and sizes are stored
    once, so the html is read twice: for them, and for the archives.
    """
    spark = pages.sparkSession
    body = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("url"), body.alias("html"))
    rows = rows.withColumn("digest", F.sha2(F.encode("html", "UTF-8"), 256)).withColumn("n", F.octet_length("html").cast("long"))
    narrow, narrow_path = store(rows.select("page_id", "digest", "n"), "page-digests")
    low, width, bins = shard_bins(narrow, shard_bytes)
    firsts = (
        narrow.filter(F.col("n") >= LEAST_REVISIT)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("c"))
        .filter("c > 1 and first is not null")
        .select(F.col("digest").alias("_d"), "first")
    )
    revisits = narrow.join(firsts, F.col("digest") == F.col("_d")).filter(~F.col("page_id").eqNullSafe(F.col("first")))
    # Decisions and pages meet in one shuffle, by (page id, digest): a page's html moves once.
    both = revisits.select("page_id", "digest", F.col("first").alias("refers_to"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html")).unionByName(
        rows.select("page_id", "digest", F.lit(None).cast("long").alias("refers_to"), F.coalesce("url", F.lit("")).alias("url"), "html")
    )
    table = spark.createDataFrame(bins, "_bin long, _shard long, _parts long")
    placed = both.join(F.broadcast(table), F.floor((F.col("page_id") - low) / width) == F.col("_bin"), "left")
    lead = F.conv(F.substring("digest", 1, 8), 16, 10).cast("long")
    shard = F.coalesce(F.col("_shard") + F.floor(lead * F.col("_parts") / (1 << 32)), F.lit(0))
    count = max([s + p for _, s, p in bins], default=1)
    tasks = max(min(count, 4 * spark.sparkContext.defaultParallelism), -(-count // TASK_SHARDS))
    sorted_rows = (
        placed.select(shard.alias("shard"), "page_id", "digest", "refers_to", "url", "html")
        .repartitionByRange(tasks, "shard")
        .sortWithinPartitions(F.col("shard"), F.col("page_id"), F.col("digest"), F.col("html").isNotNull(), F.col("url"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        temp = f"{path}/_temporary/{uuid.uuid4().hex}"
        fs, root = pfs.FileSystem.from_uri(temp)
        fs.create_dir(root, recursive=True)
        out, revisit = None, None
        for batch in batches:
            made = []
            for shard, page_id, digest, refers_to, url, html in zip(*(c.to_pylist() for c in batch.columns)):
                if html is None:
                    revisit = (page_id, digest, refers_to)
                    continue
                if out is None or out["shard"] != shard or out["bytes"] >= file_bytes:
                    if out is not None:
                        made.append(_close(out, temp))
                    number = out["number"] + 1 if out is not None and out["shard"] == shard else 0
                    out = _open(fs, root, shard, number)
                to = revisit[2] if revisit is not None and revisit[:2] == (page_id, digest) else None
                data = make_record(page_id, url, html.encode("utf-8"), digest, to)
                out["file"].write(data)
                out["hash"].update(data)
                out["bytes"] += len(data)
                out["records"] += 1
            if made:
                yield _files(made)
        if out is not None:
            yield _files([_close(out, temp)])

    listed = sorted_rows.mapInArrow(run, FILE_SCHEMA)
    listed.write.json(f"{path}/_written")
    written = spark.read.schema(FILE_SCHEMA).json(f"{path}/_written")

    def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pfs.FileSystem.from_uri(path)
        for batch in batches:
            for temp, name, size in zip(*(batch.column(c).to_pylist() for c in ("temp", "name", "bytes"))):
                _, source = pfs.FileSystem.from_uri(f"{temp}/{name}")
                target = posixpath.join(root, name)
                if fs.get_file_info(source).type == pfs.FileType.File:
                    fs.move(source, target)
                if fs.get_file_info(target).size != size:  # a task that ran before may have moved it
                    raise OSError(f"{name} is not whole")
            yield batch

    written.mapInArrow(rename, FILE_SCHEMA).drop("temp").write.json(f"{path}/manifest")
    discard(spark, narrow_path)


def _open(fs, root: str, shard: int, number: int) -> dict:
    name = f"shard-{shard:08d}-{number:05d}.warc.gz"
    stream = fs.open_output_stream(f"{root}/{name}", compression=None)
    return {"shard": shard, "number": number, "name": name, "file": stream, "hash": hashlib.sha256(), "bytes": 0, "records": 0}


def _close(out: dict, temp: str) -> tuple:
    out["file"].close()
    return temp, out["name"], out["records"], out["bytes"], out["hash"].hexdigest()


def _files(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    names = [c.split()[0] for c in FILE_SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def parse_archive(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each gzip member."""
    view, at = memoryview(data), 0
    while at < len(data):
        z, parts = zlib.decompressobj(31), []
        while not z.eof:
            if at >= len(data):
                raise ValueError("a record is cut off")
            piece = view[at : at + _READ]  # what is left over of a piece is all that is copied
            parts.append(z.decompress(piece))
            at += len(piece) - len(z.unused_data)
        raw = b"".join(parts)
        head, _, rest = raw.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError("not a WARC record")
        fields = dict(x.split(": ", 1) for x in (line if ": " in line else f"{line} " for line in lines[1:]))
        yield fields, rest[: int(fields["Content-Length"])]


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records of the files in the manifest; every digest is checked. A revisit has no html."""
    manifest = spark.read.schema("name string, records long, bytes long, sha256 string").json(f"{path}/manifest")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path)
    named = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    listed = named.join(manifest.select(F.col("name").alias("file"), "sha256", "records"), "file")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                name, data, digest, records = (batch.column(c)[row].as_py() for c in ("file", "content", "sha256", "records"))
                if hashlib.sha256(data).hexdigest() != digest:
                    raise ValueError(f"{name} differs from the manifest")
                rows = []
                for fields, block in parse_archive(data):
                    rows.append(_record(fields, block, payloads))
                if len(rows) != records:
                    raise ValueError(f"{name} lacks records")
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
                names = [c.split()[0] for c in RECORD_SCHEMA.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return listed.select("file", "content", "sha256", "records").mapInArrow(run, RECORD_SCHEMA)


def _record(fields: dict[str, str], block: bytes, payloads: bool) -> tuple:
    head, _, payload = block.partition(b"\r\n\r\n")
    http = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if hashlib.sha256(block).hexdigest() != fields["WARC-Block-Digest"].removeprefix("sha256:"):
        raise ValueError("block digest differs")
    page = int(fields["X-Page-Id"]) if "X-Page-Id" in fields else None
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError("payload digest differs")
    to = int(fields["X-Refers-To-Page-Id"]) if revisit else None
    text = payload.decode() if payloads and not revisit else None
    return page, fields.get("WARC-Target-URI", "").strip(), int(http["Content-Length"]), digest, fields["WARC-Type"], to, text
