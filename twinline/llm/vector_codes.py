"""Product codes of vectors: integer k-means a part, with norm-of-sum bounds that skip most rescans.

Each vector part keeps its entry, an upper bound on the distance to it and a lower bound on the distance to
each group of other entries, every bound with the round it was taken in. All rounds' codebooks are kept. A bound
from round ``t`` is moved to the present by the displacement of the entry between both codebooks, the norm of the sum of
its moves. Adding up the norms of the moves would give a looser bound. Only groups whose bound does not
rule them out are searched again, exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinline.session import discard, small_side, store

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
GROUP = 32  # entries that share a lower bound
LARGEST = 1 << 27  # magnitude of a component: squared distances fit 63 bits up to 64 components a part
_SLACK = 1e-9  # relative, for the rounding of bounds
_STEP = 2048  # rows of one exact search

STATE_SCHEMA = "vec_id long, label string, vector binary, code binary, upper binary, lower binary, stamp binary"
CODE_SCHEMA = "vec_id long, label string, code string, error long"
SUM_SCHEMA = "part int, entry int, n long, sums array<long>"


@dataclass
class State:
    """Rows of a batch: integer vectors ``(rows, parts, width)`` and the bounds of each part."""

    vectors: np.ndarray
    code: np.ndarray  # (rows, parts)
    upper: np.ndarray  # (rows, parts): distance to the entry, at most this when taken
    lower: np.ndarray  # (rows, parts, groups): distance to a group's other entries, at least this when taken
    upper_round: np.ndarray
    lower_round: np.ndarray

    @classmethod
    def fresh(cls, vectors: np.ndarray, groups: int) -> State:
        rows, parts, _ = vectors.shape
        return cls(
            vectors, np.zeros((rows, parts), np.uint8), np.full((rows, parts), np.inf, np.float64),
            np.zeros((rows, parts, groups), np.float32), np.zeros((rows, parts), np.uint8),
            np.zeros((rows, parts, groups), np.uint8),
        )


def squared(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows to integer entries, ``(rows, entries)``."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if 4 * most * most * max(x.shape[1], 1) < 1 << 53:  # all sums are exact in doubles
        a, b = x.astype(np.float64), entries.astype(np.float64)
        d = (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]
        return d.astype(np.int64)
    out = np.empty((len(x), len(entries)), np.int64)
    for j, e in enumerate(entries.astype(np.int64)):
        out[:, j] = ((x.astype(np.int64) - e) ** 2).sum(1)
    return out


def own_squared(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distance of each row to its own entry."""
    d = x.astype(np.int64) - entries
    return (d * d).sum(1)


class Codebooks:
    """The codebooks of all rounds so far, each ``(parts, entries, width)``, and the net moves to the last one."""

    def __init__(self, history: np.ndarray):
        self.history = history
        self.now = history[-1]
        _, self.parts, self.entries, _ = history.shape
        self.groups = [np.arange(a, min(a + GROUP, self.entries)) for a in range(0, self.entries, GROUP)]
        moves = (history - self.now[None]).astype(np.float64)
        #: Upper bounds on the net displacement of each entry since each round.
        self.moved = np.sqrt((moves * moves).sum(-1)) * (1 + _SLACK) + _SLACK
        self.group_moved = np.stack([self.moved[:, :, g].max(-1) for g in self.groups], axis=-1)

    def assign(self, s: State) -> int:
        """Bring codes and bounds to the last codebook; gives the number of (row, part, group) searches."""
        this = len(self.history) - 1
        searched = 0
        for p in range(self.parts):
            if this == 0:
                searched += self._search_all(s, p)
                continue
            rows = np.arange(len(s.vectors))
            upper = s.upper[:, p] + self.moved[s.upper_round[:, p], p, s.code[:, p]]
            lower = s.lower[:, p].astype(np.float64) - self.group_moved[s.lower_round[:, p], p, np.arange(len(self.groups))]
            doubt = (lower <= upper[:, None] * (1 + _SLACK) + _SLACK).any(1)
            at = rows[doubt]
            if not len(at):
                continue
            # The distance to the own entry again, exactly; most rows then need no search.
            exact = own_squared(s.vectors[at, p], self.now[p, s.code[at, p]])
            s.upper[at, p], s.upper_round[at, p] = np.sqrt(exact), this
            wanted = lower[at] <= s.upper[at, p][:, None] * (1 + _SLACK) + _SLACK
            searched += self._search(s, p, at, exact, wanted, lower[at])
        return searched

    def _search_all(self, s: State, p: int) -> int:
        for a in range(0, len(s.vectors), _STEP):
            at = np.arange(a, min(a + _STEP, len(s.vectors)))
            far = np.full(len(at), np.iinfo(np.int64).max)
            s.code[at, p] = 0
            self._search(s, p, at, far, np.ones((len(at), len(self.groups)), bool), None)
        return len(s.vectors) * len(self.groups)

    def _search(self, s: State, p: int, at: np.ndarray, exact: np.ndarray, wanted: np.ndarray, lower: np.ndarray | None) -> int:
        """Search the ``wanted`` groups of rows ``at``, whose own entries lie at ``exact``, and renew their bounds."""
        this = len(self.history) - 1
        old = s.code[at, p].astype(np.int64)
        best, best_d = old.copy(), exact.copy()
        firsts, seconds, places = [], [], []
        for g, members in enumerate(self.groups):
            pick = np.flatnonzero(wanted[:, g])
            d = squared(s.vectors[at[pick], p], self.now[p, members])
            nearest = d.argmin(1) if len(pick) else np.empty(0, np.int64)  # ties: the lower index
            first = d[np.arange(len(pick)), nearest]
            d[np.arange(len(pick)), nearest] = np.iinfo(np.int64).max
            second = d.min(1) if len(members) > 1 else np.full(len(pick), np.iinfo(np.int64).max)
            firsts.append(first)
            seconds.append(second)
            places.append(members[nearest] if len(pick) else nearest)
            better = (first < best_d[pick]) | ((first == best_d[pick]) & (places[-1] < best[pick]))
            best[pick[better]], best_d[pick[better]] = places[-1][better], first[better]
        for g in range(len(self.groups)):
            pick = np.flatnonzero(wanted[:, g])
            # A group's bound is about entries other than the row's own.
            near = np.sqrt(np.where(places[g] == best[pick], seconds[g], firsts[g]).astype(np.float64))
            s.lower[at[pick], p, g] = np.nextafter((near * (1 - _SLACK)).astype(np.float32), np.float32(-np.inf))
            s.lower_round[at[pick], p, g] = this
        left = np.flatnonzero(best != old)
        if lower is not None and len(left):
            # The entry that was left is now one of the others of a group that may not have been searched.
            g = old[left] // GROUP
            left, g = left[~wanted[left, g]], g[~wanted[left, g]]
            known = np.minimum(lower[left, g], np.sqrt(exact[left].astype(np.float64)))
            s.lower[at[left], p, g] = np.nextafter((known * (1 - _SLACK) - _SLACK).astype(np.float32), np.float32(-np.inf))
            s.lower_round[at[left], p, g] = this
        s.code[at, p] = best
        s.upper[at, p], s.upper_round[at, p] = np.sqrt(best_d.astype(np.float64)), this
        return int(wanted.sum())


def _rows(array: np.ndarray) -> pa.Array:
    """The bytes of each row of an array."""
    flat = np.ascontiguousarray(array).reshape(len(array), -1).view(np.uint8)
    at = np.arange(len(array) + 1, dtype=np.int32) * flat.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(array), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(flat))])


def _column(batch: pa.RecordBatch, name: str, kind: str, *shape: int) -> np.ndarray:
    raw = b"".join(batch.column(name).to_pylist())
    return np.frombuffer(raw, kind).reshape(batch.num_rows, *shape).copy()


def _state_of(batch: pa.RecordBatch, parts: int, groups: int) -> State:
    vectors = _column(batch, "vector", "<i4", parts, -1) if batch.num_rows else np.empty((0, parts, 1), np.int32)
    stamp = _column(batch, "stamp", "u1", parts, groups + 1)
    return State(
        vectors, _column(batch, "code", "u1", parts), _column(batch, "upper", "<f8", parts),
        _column(batch, "lower", "<f4", parts, groups), stamp[:, :, 0].copy(), stamp[:, :, 1:].copy(),
    )


def _state_batch(batch: pa.RecordBatch, s: State) -> pa.RecordBatch:
    stamp = np.concatenate([s.upper_round[:, :, None], s.lower_round], axis=2)
    return pa.RecordBatch.from_arrays(
        [
            *[batch.column(c) for c in ("vec_id", "label")],
            _rows(s.vectors), _rows(s.code), _rows(s.upper), _rows(s.lower), _rows(stamp),
        ],
        names=[c.split()[0] for c in STATE_SCHEMA.split(", ")],
    )


def kept_vectors(table: DataFrame, vec_id: str, vector: str, label: str) -> DataFrame:
    """Rows whose vector holds finite numbers only, with components as integers ``floor(SCALE * x)``."""
    x = F.col(vector).cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    whole = F.transform(
        x, lambda v: F.when(F.abs(v) < LARGEST / SCALE, F.floor(v * SCALE)).otherwise(
            F.raise_error(F.lit(f"a component beyond {LARGEST // SCALE}"))
        ).cast("int")
    )
    return table.filter(F.coalesce(finite, F.lit(False))).select(
        F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), whole.alias("vector")
    )


def encode(
    table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
) -> tuple[DataFrame, np.ndarray]:
    """Code and error of each kept row, and the last codebooks.

    Rows whose vector is null or holds a null or non-finite component are dropped; extra columns are not read. The codebooks
    start as the parts of the ``entries`` smallest ids (missing ids last, equal ids by vector); fewer rows give
    fewer entries. Vectors of several lengths end in zeros up to the longest, and to a multiple of ``parts``. Repeated
    rows count as often as they occur. Without kept rows the codebooks are empty. One job a round writes
    codes and bounds to the shared folder, one sums the parts of each entry; both survive lost executors.
    """
    if not 0 < entries <= 256:
        raise ValueError("an entry's index is one byte")
    spark = table.sparkSession
    kept = kept_vectors(table, vec_id, vector, label)
    longest = kept.agg(F.max(F.size("vector")).alias("n")).first()["n"]
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()
    width = -(-(longest or 1) // parts) if longest is not None else 0
    if not first:
        return spark.createDataFrame([], CODE_SCHEMA), np.empty((parts, 0, width), np.int64)
    width = max(width, 1)
    start = np.zeros((len(first), parts * width), np.int64)
    for i, r in enumerate(first):
        start[i, : len(r["vector"])] = r["vector"]
    history = [np.ascontiguousarray(start.reshape(len(first), parts, width).transpose(1, 0, 2))]
    groups = -(-len(first) // GROUP)

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = Codebooks(np.stack(history))
        for batch in batches:
            lists = batch.column("vector")
            size = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            vectors = np.zeros((batch.num_rows, parts * width), np.int32)
            vectors[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
            s = State.fresh(vectors.reshape(-1, parts, width), groups)
            books.assign(s)
            yield _state_batch(batch, s)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = Codebooks(np.stack(history))
        for batch in batches:
            if batch.num_rows:
                s = _state_of(batch, parts, groups)
                books.assign(s)
                yield _state_batch(batch, s)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts, len(first), width), np.int64), np.zeros((parts, len(first)), np.int64)
        for batch in batches:
            if batch.num_rows:
                vectors = _column(batch, "vector", "<i4", parts, width)
                code = _column(batch, "code", "u1", parts)
                for p in range(parts):
                    np.add.at(total[p], code[:, p], vectors[:, p].astype(np.int64))
                    count[p] += np.bincount(code[:, p], minlength=len(first))
        p, e = np.nonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(count[p, e]), pa.array(list(total[p, e]), pa.list_(pa.int64()))],
            names=["part", "entry", "n", "sums"],
        )

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = Codebooks(np.stack(history))
        for batch in batches:
            if not batch.num_rows:
                continue
            s = _state_of(batch, parts, groups)
            books.assign(s)
            error = sum(own_squared(s.vectors[:, p], books.now[p, s.code[:, p]]) for p in range(parts))
            code = [row.tobytes().hex() for row in s.code]
            names = [c.split()[0] for c in CODE_SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names[:2]], pa.array(code), pa.array(error)], names=names)

    state, path = store(kept.mapInArrow(begin, STATE_SCHEMA), "vector-state")
    for turn in range(rounds):
        if turn:
            newer, newer_path = store(state.mapInArrow(again, STATE_SCHEMA), "vector-state")
            discard(spark, path)
            state, path = newer, newer_path
        partial = state.select("vector", "code").mapInArrow(sums, SUM_SCHEMA)
        added = [F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width)]
        # At most parts * entries rows come back.
        means = partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), *added).collect()
        book = history[-1].copy()
        for r in means:
            book[r["part"], r["entry"]] = [r[f"s{i}"] // r["n"] for i in range(width)]
        history.append(book)
    return state.mapInArrow(finish, CODE_SCHEMA), history[-1]


def codebook_digest(books: np.ndarray) -> str:
    """SHA-256 of all components as decimal text, by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(table: DataFrame, **options) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of each kept row; see :func:`encode`."""
    coded, books = encode(table, **options)
    stored, _ = store(coded, "vector-codes")
    by_label = stored.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    joined = stored.join(small_side(by_label, "label-errors"), F.col("label").eqNullSafe(F.col("_label")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(codebook_digest(books)).alias("codebooks_sha256"))
