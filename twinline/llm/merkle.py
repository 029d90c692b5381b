"""Merkle manifest of a dataset: a tree a group of rows, a tree over the groups, and proofs that fold.

Parents keep a copy of their hash state before each child slot (:mod:`shastates`). Folding a changed leaf
resumes the state of its slot with the replacement and then needs the right siblings only.

Trees are cut into blocks of ``FANOUT ** BLOCK_LEVELS`` neighbours. The way up reduces each block to its
root and goes on with the roots; the way down hands each block the path of its root. So a tree of
any size takes a few rounds, and no task holds more than a block at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinline.llm import shastates as S
from twinline.session import discard, materialize, small_side, store

FANOUT = 3
BLOCK_LEVELS = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

# One level of a path: slot, children, the state before the slot, the other children from left to right.
_RECORD = 2 + 32 * FANOUT
UP_SCHEMA = "tree string, pos long, digest binary"
DOWN_SCHEMA = "tree string, pos long, digest binary, path binary"
PROOF_SCHEMA = (
    "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
)


def field_text(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, ``:``, and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(fields: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*[field_text(f) for f in fields]), 256))


def document_leaves(docs: DataFrame) -> DataFrame:
    """``tree, doc_id, digest, replacement`` of each row; other columns are not read.

    ``tree`` orders sources bytewise with the missing one first. ``replacement`` is the digest of the row after
    tampering (every other checksum of the id, line ends deleted), null where nothing changes.
    """
    text = F.col("text")
    struck = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0) & F.contains(text, F.lit("\n"))
    fields = [F.col(c) for c in FIELDS]
    changed = leaf_digest([*fields[:-1], F.replace(text, F.lit("\n"))])
    return docs.select(
        F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), "source")).alias("tree"),
        F.col("doc_id").cast("long").alias("doc_id"),
        leaf_digest(fields).alias("digest"),
        F.when(struck, changed).alias("replacement"),
    )


def positions(nodes: DataFrame, order: list[str]) -> DataFrame:
    """``nodes`` with ``pos`` in their tree along ``order`` (nulls first) and ``size``, the nodes of the tree.

    Rows are range-sorted and stored; the runs of each tree in each partition, few rows, give the offsets.
    The row's place breaks ties, so that rows which agree in all columns are spread too.
    """
    placed, first_path = store(nodes.withColumn("_place", F.monotonically_increasing_id()), "merkle-nodes")
    keys = ["tree", *order, "_place"]
    ordered = placed.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_place")
    stored = materialize(ordered.withColumn("_at", F.monotonically_increasing_id()), "merkle-order")
    stored = stored.withColumn("_part", F.shiftright("_at", 33))
    runs = stored.groupBy("tree", "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    of_tree = Window.partitionBy("tree")
    before = of_tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = runs.select(
        F.col("tree").alias("_tree"), F.col("_part").alias("_p"),
        (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_n").over(of_tree).alias("size"),
    )
    joined = stored.join(small_side(offsets, "merkle-runs"), (F.col("tree") == F.col("_tree")) & (F.col("_part") == F.col("_p")))
    discard(nodes.sparkSession, first_path)
    numbered = joined.withColumn("pos", F.col("_at") + F.col("_shift"))
    return numbered.drop("_tree", "_p", "_part", "_at", "_shift")


def levels_of(size: int) -> int:
    """Levels from ``size`` nodes to one."""
    levels = 0
    while size > 1:
        size, levels = -(-size // FANOUT), levels + 1
    return levels


class Level:
    """One level of many blocks at once: each node's parent, slot, run size and state before the slot."""

    def __init__(self, digests: np.ndarray, firsts: np.ndarray):
        self.digests = digests
        sizes = np.diff(firsts)
        parents = -(-sizes // FANOUT)
        self.next_firsts = np.concatenate(([0], np.cumsum(parents)))
        inside = np.arange(digests.shape[1]) - np.repeat(firsts[:-1], sizes)
        self.slot = inside % FANOUT
        self.parent = np.repeat(self.next_firsts[:-1], sizes) + inside // FANOUT
        self.run = np.bincount(self.parent, minlength=int(self.next_firsts[-1]))
        self.first = np.concatenate(([0], np.cumsum(self.run)))[:-1]  # a parent's children are neighbours
        state = np.repeat(S.START, len(self.run), axis=1)
        self.states = [state]
        for k in range(FANOUT):
            at = np.flatnonzero(self.run > k)
            state = state.copy()
            state[:, at] = S.absorb(state[:, at], digests[:, self.first[at] + k])
            self.states.append(state)
        self.next_digests = S.finish(state, self.run)

    def before(self) -> np.ndarray:
        """State before each node's slot."""
        return np.stack(self.states)[self.slot, :, self.parent].T

    def others(self, k: int) -> np.ndarray:
        """Index of each node's ``k``-th other child of the run; itself where there is none."""
        at = k + (k >= self.slot)
        own = np.arange(len(self.slot))
        return np.where(at < self.run[self.parent], self.first[self.parent] + at, own)

    def records(self) -> np.ndarray:
        """Each node's path record as bytes."""
        out = np.empty((len(self.slot), _RECORD), np.uint8)
        out[:, 0], out[:, 1] = self.slot, self.run[self.parent]
        out[:, 2:34] = S.to_bytes(self.before())
        raw = S.to_bytes(self.digests)
        for k in range(FANOUT - 1):
            out[:, 34 + 32 * k : 66 + 32 * k] = raw[self.others(k)]
        return out


def grow(digests: np.ndarray, firsts: np.ndarray, levels: int) -> tuple[list[Level], np.ndarray]:
    """``levels`` levels over blocks that begin at ``firsts``, and the block roots."""
    made = []
    for _ in range(levels):
        made.append(Level(digests, firsts))
        digests, firsts = made[-1].next_digests, made[-1].next_firsts
    return made, digests


class Climb:
    """Many nodes on their way up: the folded digest and the state of the hash over all siblings."""

    def __init__(self, digests: np.ndarray):
        self.folded = digests
        self.proof = np.repeat(S.START, digests.shape[1], axis=1)
        self.blocks = np.zeros(digests.shape[1], np.int64)

    def step(self, slot: np.ndarray, run: np.ndarray, before: np.ndarray, others: list[np.ndarray]) -> None:
        """``others[k]``: digests of the k-th other child, meaningless beyond the run."""
        state = S.absorb(before, self.folded)
        for k, sibling in enumerate(others):
            at = np.flatnonzero(k < run - 1)
            self.proof[:, at] = S.absorb(self.proof[:, at], sibling[:, at])
            self.blocks[at] += 1
            right = at[k >= slot[at]]
            state[:, right] = S.absorb(state[:, right], sibling[:, right])
        self.folded = S.finish(state, run)

    def proof_digests(self) -> np.ndarray:
        return S.finish(self.proof, self.blocks)


def _digests(column: pa.Array) -> np.ndarray:
    return S.from_bytes(b"".join(column.to_pylist()))


def _binaries(rows: np.ndarray) -> pa.Array:
    """Rows of bytes as a binary column."""
    at = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(rows))])


def _hex(digests: np.ndarray) -> pa.Array:
    text = np.ascontiguousarray(S.hex_block(digests).T).astype(">u4").view(np.uint8).reshape(-1, 64)
    return _binaries(text).cast(pa.string())


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole blocks of sorted rows; the last of a batch waits for the next batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        table = pa.Table.from_batches(held)
        cut = int(_firsts(table)[-2])
        if cut:
            yield table.slice(0, cut).combine_chunks()
            held = table.slice(cut).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _firsts(table: pa.Table) -> np.ndarray:
    """Where each (tree, block) begins, and the end."""
    block = table.column("block").to_numpy()
    code = table.column("tree").combine_chunks().dictionary_encode().indices.to_numpy()
    new = np.flatnonzero((block[1:] != block[:-1]) | (code[1:] != code[:-1])) + 1
    return np.concatenate(([0], new, [len(block)]))


def _same_height(table: pa.Table, most: int) -> Iterator[tuple[pa.Table, np.ndarray, int]]:
    """Parts of ``table`` whose blocks have the same number of levels, at most ``most``, with their begins."""
    firsts = _firsts(table)
    size = table.column("size").to_numpy()[firsts[:-1]]
    height = np.array([min(levels_of(int(n)), most) for n in size])
    for h in np.unique(height):
        pick = np.flatnonzero(height == h)
        rows = np.concatenate([np.arange(firsts[i], firsts[i + 1]) for i in pick])
        cuts = np.concatenate(([0], np.cumsum(np.diff(firsts)[pick])))
        yield table.take(pa.array(rows)).combine_chunks(), cuts, int(h)


def _in_blocks(nodes: DataFrame, levels: int) -> DataFrame:
    """Rows of a block together and in order; a tree of any share of the rows lies in many blocks."""
    cut = nodes.withColumn("block", F.floor(F.col("pos") / FANOUT**levels))
    return cut.repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")


def _reduce(nodes: DataFrame, levels: int) -> DataFrame:
    """Block roots, as the nodes of the next round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _blocks(batches):
            for part, firsts, height in _same_height(table, levels):
                _, roots = grow(_digests(part.column("digest")), firsts, height)
                at = pa.array(firsts[:-1])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("tree").take(at).combine_chunks(), part.column("block").take(at).combine_chunks(),
                        _binaries(S.to_bytes(roots)),
                    ],
                    names=["tree", "pos", "digest"],
                )

    rows = _in_blocks(nodes.select("tree", "pos", "digest", "size"), levels).select("tree", "block", "digest", "size")
    return rows.mapInArrow(run, UP_SCHEMA)


def _climb(nodes: DataFrame, levels: int) -> list[DataFrame]:
    """The nodes of each round, from ``nodes`` to those with one root a tree."""
    rounds = [nodes]
    largest = nodes.agg(F.max("size").alias("n")).first()["n"]
    while largest > 1:
        roots = materialize(_reduce(rounds[-1], levels), "merkle-roots")
        sizes = F.ceil(F.col("size") / FANOUT**levels)
        tree_sizes = nodes.filter("pos = 0").select(F.col("tree").alias("_t"), "size")
        for _ in rounds:
            tree_sizes = tree_sizes.withColumn("size", sizes)
        rounds.append(roots.join(small_side(tree_sizes, "merkle-sizes"), F.col("tree") == F.col("_t")).drop("_t"))
        largest = -(-largest // FANOUT**levels)
    return rounds


def _with_paths(nodes: DataFrame, paths: DataFrame, levels: int) -> DataFrame:
    """The nodes of each block behind one row, at place -1, with the path of the block's root."""
    given = paths.select(
        "tree", F.col("pos").alias("block"), F.lit(-1).cast("long").alias("pos"), "digest", "path",
        *[F.lit(None).cast(t).alias(c) for c, t in nodes.dtypes if c not in ("tree", "pos", "digest")],
    )
    cut = nodes.withColumn("block", F.floor(F.col("pos") / FANOUT**levels))
    both = cut.unionByName(given, allowMissingColumns=True)
    return both.repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")


def _part_with_paths(table: pa.Table, most: int) -> Iterator[tuple[pa.Table, np.ndarray, int, list[bytes], list[bytes]]]:
    """Nodes with equal heights, their begins, the height, and each block's path and the digest given with it."""
    firsts = _firsts(table)
    paths = table.column("path").combine_chunks().take(pa.array(firsts[:-1])).to_pylist()
    roots = table.column("digest").combine_chunks().take(pa.array(firsts[:-1])).to_pylist()
    keep = np.ones(table.num_rows, bool)
    keep[firsts[:-1]] = False
    rest = table.filter(pa.array(keep)).append_column(
        "_block", pa.array(np.repeat(np.arange(len(firsts) - 1), np.diff(firsts) - 1))
    )
    for part, cuts, height in _same_height(rest, most):
        which = part.column("_block").to_numpy()[cuts[:-1]]
        yield part, cuts, height, [paths[i] for i in which], [roots[i] for i in which]


def _descend(nodes: DataFrame, paths: DataFrame, levels: int) -> DataFrame:
    """Path of every node: its records inside the block, then the path of the block's root."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _blocks(batches):
            for part, firsts, height, above, _ in _part_with_paths(table, levels):
                made, _ = grow(_digests(part.column("digest")), firsts, height)
                at = np.arange(part.num_rows)
                own = []
                for level in made:
                    own.append(level.records()[at])
                    at = level.parent[at]
                inside = np.concatenate(own, axis=1) if own else np.empty((part.num_rows, 0), np.uint8)
                up = np.repeat(np.arange(len(above)), np.diff(firsts))
                whole = [x.tobytes() + above[i] for x, i in zip(inside, up)]
                columns = [part.column(c).combine_chunks() for c in ("tree", "pos", "digest")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(whole, pa.binary())], names=["tree", "pos", "digest", "path"])

    rows = _with_paths(nodes.select("tree", "pos", "digest", "size"), paths, levels)
    return rows.select("tree", "block", "pos", "digest", "size", "path").mapInArrow(run, DOWN_SCHEMA)


def _paths_above(paths: list[bytes], firsts: np.ndarray) -> Iterator[tuple[np.ndarray, tuple]]:
    """Level by level: the rows that have it, and the arguments of :meth:`Climb.step`."""
    sizes = np.diff(firsts)
    depth = np.array([len(p) // _RECORD for p in paths])
    rows_of = np.repeat(np.arange(len(paths)), sizes)
    for k in range(int(depth.max(initial=0))):
        having = np.flatnonzero(depth > k)
        raw = np.frombuffer(b"".join(paths[i][k * _RECORD : (k + 1) * _RECORD] for i in having), np.uint8).reshape(-1, _RECORD)
        place = np.full(len(paths), -1)
        place[having] = np.arange(len(having))
        rows = np.flatnonzero(depth[rows_of] > k)
        at = place[rows_of[rows]]
        cut = [S.from_bytes(raw[:, 2 + 32 * j : 34 + 32 * j].tobytes())[:, at] for j in range(FANOUT)]
        yield rows, (raw[at, 0].astype(np.int64), raw[at, 1].astype(np.int64), cut[0], cut[1:])


def _prove(leaves: DataFrame, paths: DataFrame, root: bytes, levels: int) -> DataFrame:
    """The proof and the folded root of every leaf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _blocks(batches):
            for part, firsts, height, above, subroots in _part_with_paths(table, levels):
                digests = _digests(part.column("digest"))
                made, _ = grow(digests, firsts, height)
                changed = part.column("replacement").combine_chunks()
                changed = changed.fill_null(b"\0" * 32) if changed.null_count < len(changed) else None
                climb = Climb(digests)
                if changed is not None:
                    has = part.column("replacement").combine_chunks().is_valid().to_numpy(zero_copy_only=False)
                    climb.folded = np.where(has, _digests(changed), digests)
                at = np.arange(part.num_rows)
                for level in made:
                    others = [level.digests[:, level.others(k)[at]] for k in range(FANOUT - 1)]
                    climb.step(level.slot[at], level.run[level.parent[at]], level.before()[:, at], others)
                    at = level.parent[at]
                for rows, args in _paths_above(above, firsts):
                    if len(rows) == part.num_rows:
                        climb.step(*args)
                        continue
                    some = Climb(climb.folded[:, rows])
                    some.proof, some.blocks = climb.proof[:, rows], climb.blocks[rows]
                    some.step(*args)
                    climb.folded[:, rows], climb.proof[:, rows], climb.blocks[rows] = some.folded, some.proof, some.blocks
                own = np.repeat(np.arange(len(subroots)), np.diff(firsts))
                subroot = S.from_bytes(b"".join(subroots))[:, own]
                whole = np.repeat(S.from_bytes(root), part.num_rows, axis=1)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").combine_chunks(), _hex(digests), _hex(subroot), _hex(whole),
                        _hex(climb.proof_digests()), _hex(climb.folded), pa.array((climb.folded == whole).all(axis=0)),
                    ],
                    names=[c.split()[0] for c in PROOF_SCHEMA.split(", ")],
                )

    rows = _with_paths(leaves, paths, levels)
    return rows.select("tree", "block", "pos", "doc_id", "digest", "replacement", "size", "path").mapInArrow(run, PROOF_SCHEMA)


def _tree_paths(rounds: list[DataFrame], paths: DataFrame, levels: int) -> DataFrame:
    """Paths of the nodes of the second round, from those of the trees' roots."""
    for nodes in reversed(rounds[1:-1]):
        paths = materialize(_descend(nodes, paths, levels), "merkle-paths")
    return paths


def manifest(leaves: DataFrame, block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """Proof and check of every leaf of ``tree, doc_id, digest, replacement``.

    Leaves of a tree ascend by id (missing ids first), equal ids by digest. Each run of ``FANOUT`` neighbours becomes the
    hash of their hexadecimal digests, the last run with fewer, until one node remains: the subroot. The subroots, by tree, give
    the root likewise. ``proof_sha256`` hashes all siblings of a leaf from its level to the root, left to right;
    ``folded_root`` is the root recomputed from ``replacement`` (the leaf where null) and these siblings. Every row
    has its row in the result, repeated ids and rows too. A table without rows has none.
    """
    spark = leaves.sparkSession
    numbered = positions(leaves, ["doc_id", "digest"])
    if numbered.isEmpty():
        return spark.createDataFrame([], PROOF_SCHEMA)
    rounds = _climb(numbered, block_levels)
    named = positions(rounds[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"), ["name"])
    forest = _climb(named, block_levels)
    root = bytes(forest[-1].first()["digest"])
    above = _tree_paths(forest, spark.createDataFrame([("", 0, root, b"")], DOWN_SCHEMA), block_levels)
    if len(forest) > 1:
        above = materialize(_descend(named, above, block_levels), "merkle-paths")
    # Each tree's name and subroot come back by the place of its root among the roots.
    roots = named.select("pos", "name", F.col("digest").alias("subroot")).join(above.select("pos", "path"), "pos")
    first = F.lit(0).cast("long").alias("pos")
    trees = materialize(roots.select(F.col("name").alias("tree"), first, F.col("subroot").alias("digest"), "path"), "merkle-trees")
    paths = _tree_paths(rounds, trees, block_levels)
    if len(rounds) > 2:
        subroots = small_side(trees.select(F.col("tree").alias("_t"), F.col("digest").alias("_subroot")), "merkle-subroots")
        paths = paths.join(subroots, F.col("tree") == F.col("_t")).select("tree", "pos", F.col("_subroot").alias("digest"), "path")
    return _prove(numbered, paths, root, block_levels)
