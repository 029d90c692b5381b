"""Packing of token ids into windows by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinline.llm.tokens import encode_whole, slices

PIECE_SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
SPARE = 6  # tokens a window leaves for the differences that remain
TASK_BITS = 40  # of a sequence id hold its number in the task


def differencing(sizes: list[int], windows: int) -> list[list[int]]:
    """Split items into ``windows`` lists with near-equal sums.

    Each item starts as a partial partition with one filled window. The two partitions with the largest
    imbalance are merged again and again, the fullest window of one with the emptiest of the other.
    """
    # A window is its sum and a node: an item, or a pair of nodes beyond the items; -1 is empty.
    heap = [(-s, i, [(s, i)] + [(0, -1)] * (windows - 1)) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    if not heap:
        return [[] for _ in range(windows)]
    count, pairs = len(sizes), []
    tie = count
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heap[0]
        merged = []
        for (x, p), (y, q) in zip(a, reversed(b)):
            if p < 0:
                p = q
            elif q >= 0:
                pairs.append((p, q))
                p = count + len(pairs) - 1
            merged.append((x + y, p))
        merged.sort(reverse=True)  # sums fall from first to last
        low = merged[-1][0]
        if low:
            merged = [(s - low, p) for s, p in merged]
        heapq.heapreplace(heap, (-merged[0][0], tie, merged))
        tie += 1
    return [_members(node, count, pairs) for _, node in heap[0][2]]


def _members(node: int, count: int, pairs: list[tuple[int, int]]) -> list[int]:
    out, open_nodes = [], [node]
    while open_nodes:
        n = open_nodes.pop()
        if n >= count:
            open_nodes += pairs[n - count]
        elif n >= 0:
            out.append(n)
    return out


def fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Windows of at most ``capacity``; one more window whenever the fullest is beyond it."""
    if max(sizes, default=0) > capacity:
        raise ValueError("an item is larger than a window")
    windows = max(1, -(-sum(sizes) // capacity))
    while True:
        found = differencing(sizes, windows)
        if all(sum(sizes[i] for i in w) <= capacity for w in found):
            return [w for w in found if w]
        windows += 1


def pack(
    docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 1024, doc_id: str = "doc_id", text: str = "text",
    windows_a_block: int = 32, longest_cut: int = 192,
) -> DataFrame:
    """One row a piece: ``doc_id, start, length, doc_tokens, sequence_id, offset, ids``.

    ``ids`` are little-endian unsigned 32-bit. Documents are cut into full windows; what is left is
    cut into pieces of at most ``longest_cut`` ids and shared out by :func:`fit`, ``windows_a_block``
    windows at a time. Null texts are empty and hold the end id alone. Every row is packed, those that
    share an id or have none too. Tasks pack what they read: nothing is shuffled, and a task
    holds one block. A sequence id is made of the task and a counter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId() << TASK_BITS, 0
        aim = windows_a_block * (capacity - SPARE)
        held: list[tuple] = []  # (doc_id, start, doc_tokens, ids)
        total = 0

        def block() -> list[tuple]:
            nonlocal made
            rows = []
            for window in fit([len(x[3]) for x in held], capacity):
                offset = 0
                for i in window:
                    d, start, n, ids = held[i]
                    rows.append((d, start, len(ids), n, task + made, offset, ids.tobytes()))
                    offset += len(ids)
                made += 1
            return rows

        for batch in batches:
            for s in slices(batch, "text"):
                ids, counts = encode_whole(s.column("text"), tokenizer, end_id)
                ids = ids.astype("<u4")
                rows, first = [], 0
                for d, n in zip(s.column("doc_id").to_pylist(), counts.tolist()):
                    whole = n // capacity * capacity
                    for at in range(0, whole, capacity):
                        rows.append((d, at, capacity, n, task + made, 0, ids[first + at : first + at + capacity].tobytes()))
                        made += 1
                    at = whole
                    while at < n:
                        size = min(longest_cut, n - at, aim - total)
                        held.append((d, at, n, ids[first + at : first + at + size]))
                        total, at = total + size, at + size
                        if total == aim:
                            rows += block()
                            held, total = [], 0
                    first += n
                yield _batch(rows)
        if held:
            yield _batch(block())

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, PIECE_SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 6 + [pa.binary()]
    columns = list(zip(*rows)) if rows else [()] * 7
    names = [c.split()[0] for c in PIECE_SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)
