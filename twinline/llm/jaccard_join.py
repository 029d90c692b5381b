"""N-gram Jaccard join: a prefix-tree join on globally ordered shingle sets.

Two sets with 9 x overlap >= 4 x (sum of sizes), which is a Jaccard similarity of 0.8, share at least
``k`` of the first ``n - ceil(0.8 n) + k`` shingles in any order that all sets follow; ``k`` is 6 % of the smaller set. Here rare shingles come first, as
told by a table of hashed counts of fixed size; then a passage that very many documents share falls behind
the prefixes. Sets that share too few
prefix shingles with all others link with none; only the sets of the rest are moved.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinline.llm.graph import components
from twinline.llm.tokens import ragged, slices
from twinline.llm.wordhash import mix, windows, words_of
from twinline.session import discard, store

SIZE = 5
TABLE_BITS = 18  # of the hashed counts: what the driver and the tasks hold of the corpus
CLASS_BITS = 5
BLOOM_BITS = 25
BLOCK = 256  # sets in one prefix tree
OPEN_BLOCK = 1024  # sets on either side of a comparison of two blocks
FEW = 64  # sets of a token whose pairs are counted as rows; beyond, blocks of them meet in trees
MANY = 16  # sets from which a tree is walked for all of them at once
_CELLS = 32 << 20  # of the table of tree tokens and sets held at once
_SLICE = 6 << 20


def linked(overlap, a, b):
    """The similarity rule: 100 x overlap >= 80 x union."""
    return 9 * overlap >= 4 * (a + b)


def least_shared(n):
    """Prefix tokens that a set of ``n`` has in common with any larger set it links with."""
    return np.maximum(1, 6 * n // 100)


def prefix_size(n):
    """``n - ceil(0.8 n)`` and as many tokens as must be shared."""
    return n - (4 * n + 4) // 5 + least_shared(n)


def _least(n: str) -> Column:
    return F.expr(f"greatest(1, 6 * {n} div 100)")


def shingles(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all 5-word windows of each text and the text of each; fewer words make one, none make none."""
    words = words_of(column)
    h, n, firsts = words.hashes, words.counts, words.firsts
    count = np.where(n >= SIZE, n - SIZE + 1, (n > 0).astype(np.int64))
    out = np.empty(int(count.sum()), np.uint64)
    long = n >= SIZE
    at = np.cumsum(count) - count
    every = windows(h, SIZE)
    out[ragged(at[long], count[long])] = every[ragged(firsts[:-1][long], count[long])]
    for i in np.flatnonzero((n > 0) & ~long):
        x = np.array([0xA5A5 + n[i]], np.uint64)
        for w in h[firsts[i] : firsts[i + 1]]:
            x = mix(x * np.uint64(0x9E3779B97F4A7C15) + w)
        out[at[i]] = x[0]
    return out, np.repeat(np.arange(len(n)), count)


def hashed_counts(docs: DataFrame, text: str) -> np.ndarray:
    """Shingles of all documents counted by the first bits of their hash: 2^18 numbers whatever the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(1 << TABLE_BITS, np.int64)
        for batch in batches:
            for s in slices(batch, text, _SLICE):
                h, _ = shingles(s.column(text))
                held += np.bincount((h >> np.uint64(64 - TABLE_BITS)).astype(np.int64), minlength=len(held))
        parts = held.astype(np.uint32).reshape(64, -1)
        yield pa.RecordBatch.from_arrays([pa.array(range(64), pa.int32()), pa.array([p.tobytes() for p in parts])], names=["part", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, raw in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist()):
                got = np.frombuffer(raw, np.uint32).astype(np.int64)
                sums[part] = sums[part] + got if part in sums else got
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], names=["part", "counts"]
        )

    parts = docs.select(text).mapInArrow(run, "part int, counts binary")
    sums = parts.repartition(64, "part").mapInArrow(add, "part int, counts binary").collect()
    out = np.zeros((64, (1 << TABLE_BITS) // 64), np.int64)
    for r in sums:
        out[r["part"]] = np.frombuffer(r["counts"], np.int64)
    return out.reshape(-1)


def rarity(counts: np.ndarray) -> np.ndarray:
    """A class from 0, rare, by how far a count stands out from what chance puts into a place of the table."""
    mean = counts.mean() if len(counts) else 0.0
    over = np.maximum(counts - mean - 6 * np.sqrt(mean) - 4, 0)
    return np.minimum(np.ceil(np.log2(over + 1)), (1 << CLASS_BITS) - 1).astype(np.uint64)


def ordered_sets(column: pa.Array, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All sets in a row, each in the global order; their sizes; a 64-bit digest of each (0: empty).

    A token is the class in its first bits and the hash below it, so the order is that of the numbers.
    """
    h, of = shingles(column)
    cls = classes[(h >> np.uint64(64 - TABLE_BITS)).astype(np.int64)]
    token = (cls << np.uint64(64 - CLASS_BITS - 1)) | (mix(h) >> np.uint64(CLASS_BITS + 1))
    order = np.lexsort((token, of))
    token, of = token[order], of[order]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (of[1:] != of[:-1])
    token, of = token[new], of[new]
    n = np.bincount(of, minlength=len(column)).astype(np.int64)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(token * np.uint64(0xD6E8FEB86659FD93)), dtype=np.uint64)))
    at = np.concatenate(([0], np.cumsum(n)))
    digest = mix((sums[at[1:]] - sums[at[:-1]]) * np.uint64(0x9E3779B97F4A7C15) + n.astype(np.uint64))
    return token, n, np.where(n > 0, digest, 0)


class Tree:
    """Ordered sets in a prefix tree with compressed paths."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        self.order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u8").tobytes())
        self.root = self._node(0, len(sets), 0) if sets else None

    def _node(self, lo: int, hi: int, depth: int) -> tuple:
        a, b = self.sets[self.order[lo]], self.sets[self.order[hi - 1]]
        m = min(len(a), len(b))
        if hi - lo == 1:
            end = len(a)
        else:
            differ = np.flatnonzero(a[depth:m] != b[depth:m])
            end = depth + int(differ[0]) if len(differ) else m
        sizes = [len(self.sets[self.order[i]]) for i in range(lo, hi)]
        here, children, at = [], [], lo
        while at < hi and len(self.sets[self.order[at]]) == end:
            here.append(self.order[at])
            at += 1
        while at < hi:
            token, start = self.sets[self.order[at]][end], at
            while at < hi and self.sets[self.order[at]][end] == token:
                at += 1
            children.append(self._node(start, at, end))
        return a[depth:end], end, min(sizes), max(sizes), here, children

    def probe(self, x: np.ndarray, skip) -> Iterator[int]:
        """Sets that link with ``x``; branches are left when the remaining lengths cannot reach the overlap."""
        stack = [(self.root, 0)] if self.root else []
        while stack:
            (part, end, low, high, here, children), overlap = stack.pop()
            if 4 * (len(x) + low) > 9 * min(len(x), high):
                continue
            if not children and all(skip(i) for i in here):
                continue
            if len(part):
                at = np.searchsorted(x, part)
                overlap += int(np.count_nonzero(x[np.minimum(at, len(x) - 1)] == part))
                left = len(x) - int(np.searchsorted(x, part[-1], "right"))
            else:
                left = len(x) - overlap
            if 9 * (overlap + min(left, high - end)) < 4 * (len(x) + low):
                continue
            for i in here:
                if linked(overlap, len(x), len(self.sets[i])):
                    yield i
            stack += [(c, overlap) for c in children]


    def walk(self, others: list[np.ndarray], same) -> Iterator[tuple[int, np.ndarray]]:
        """``(i, links)``: for sets of the tree, which of ``others`` link with them.

        One walk serves all the others: a node adds its tokens to the overlaps of those that can still
        reach the similarity by the remaining lengths. ``same(i, them)`` tells which of them need no comparison with ``i``.
        """
        tokens = np.unique(np.concatenate(self.sets)) if self.sets else np.empty(0, np.uint64)
        step = max(1, _CELLS // max(1, len(tokens)))
        for a in range(0, len(others), step):
            yield from self._walk(tokens, others[a : a + step], a, same)

    def _walk(self, tokens: np.ndarray, others: list[np.ndarray], first: int, same) -> Iterator[tuple[int, np.ndarray]]:
        size = np.array([len(x) for x in others])
        of, flat = np.repeat(np.arange(len(others)), size), np.concatenate(others)
        rank = np.searchsorted(tokens, flat)
        inside = tokens[np.minimum(rank, len(tokens) - 1)] == flat
        has = np.zeros((len(tokens), len(others)), np.uint8)
        has[rank[inside], of[inside]] = 1
        width = len(tokens) + 1
        placed, before = of * width + rank, np.cumsum(size) - size
        stack = [(self.root, np.arange(len(others)), np.zeros(len(others), np.int64))] if self.root else []
        while stack:
            (part, end, low, high, here, children), live, overlap = stack.pop()
            able = 4 * (size[live] + low) <= 9 * np.minimum(size[live], high)
            if not children and len(here) == 1:
                able &= ~same(here[0], first + live)
            live, overlap = live[able], overlap[able]
            if not len(live):
                continue
            left = size[live] - overlap
            if len(part):
                at = np.searchsorted(tokens, part)
                overlap = overlap + has[at[:, None], live].sum(0, dtype=np.int64)
                left = size[live] - (np.searchsorted(placed, live * width + at[-1], "right") - before[live])
            able = 9 * (overlap + np.minimum(left, high - end)) >= 4 * (size[live] + low)
            live, overlap = live[able], overlap[able]
            for i in here:
                found = live[linked(overlap, size[live], len(self.sets[i]))]
                if len(found):
                    yield i, first + found
            if len(live):
                stack += [(c, live, overlap) for c in children]


def tree_links(
    sets: list[np.ndarray], own: list[int] | None = None, left: int | None = None
) -> tuple[list[tuple[int, int]], list[int]]:
    """Links that join the sets, and each set's local component.

    A set is not compared again with a component that it already belongs to: what is left out
    cannot change the components. ``own`` gives components known before. With ``left``, only the first
    so many sets meet the others, not each other.
    """
    numbers: dict[int, int] = {}
    label = np.array([numbers.setdefault(c, i) for i, c in enumerate(own or range(len(sets)))], np.int64)
    links: list[tuple[int, int]] = []

    def join(i: int, j: int) -> None:
        a, b = sorted((label[i], label[j]))
        if a != b:
            links.append((i, j))
            label[label == b] = a

    tree, others = Tree(sets[:left]), 0 if left is None else left
    if len(sets) < MANY:
        for i in range(others, len(sets)):
            for j in tree.probe(sets[i], lambda k, i=i: label[k] == label[i]):
                join(i, j)
    elif others < len(sets):
        for j, found in tree.walk(sets[others:], lambda k, them: label[others + them] == label[k]):
            for i in others + found:
                join(int(i), j)
    return links, label.tolist()


def document_sets(docs: DataFrame, doc_id: str, text: str, classes: np.ndarray) -> DataFrame:
    """``doc_id, n, sid, prefix``: a set's digest is its id; a task gives the prefix of equal sets once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for s in slices(batch, "text", _SLICE):
                token, n, sid = ordered_sets(s.column("text"), classes)
                fresh = np.array([not (k in seen or seen.add(k)) for k in sid.tolist()]) & (n > 0)
                size = np.where(fresh, prefix_size(n), 0)
                at = np.cumsum(n) - n
                prefix = token[ragged(at, size)].view(np.int64)
                cuts = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [s.column("doc_id"), pa.array(n), pa.array(sid.view(np.int64)), pa.ListArray.from_arrays(pa.array(cuts), pa.array(prefix))],
                    names=["doc_id", "n", "sid", "prefix"],
                )

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, sid long, prefix array<long>")


def shared_tokens(sets: DataFrame) -> DataFrame:
    """``token, sid, n`` of prefix tokens that two sets have or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None  # the last row, not given out yet
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            carried = held is not None
            token, sid = rows.column("token").to_numpy(), rows.column("sid").to_numpy()
            same = token[1:] == token[:-1]
            fresh = np.ones(len(token), bool)
            fresh[1:] = ~same | (sid[1:] != sid[:-1])
            # Rows of the carried token that went out before: the mark is in n's sign.
            keep = np.flatnonzero(fresh)
            t = token[keep]
            more = np.zeros(len(keep), bool)
            more[1:] |= t[1:] == t[:-1]
            more[:-1] |= t[1:] == t[:-1]
            n = rows.column("n").to_numpy()[keep]
            gone = np.zeros(len(keep), bool)
            if carried:
                gone[0] = n[0] < 0
                more |= (t == t[0]) & gone[0]
            out = more & ~gone
            held_out = bool(more[-1])
            last = keep[-1]
            size = int(abs(n[-1]))
            held = pa.RecordBatch.from_arrays(
                [pa.array([token[last]]), pa.array([sid[last]]), pa.array([-size if held_out else size])], names=["token", "sid", "n"]
            )
            pick = np.flatnonzero(out)
            yield pa.RecordBatch.from_arrays(
                [pa.array(t[pick]), pa.array(sid[keep][pick]), pa.array(np.abs(n[pick]))], names=["token", "sid", "n"]
            )

    rows = sets.filter(F.size("prefix") > 0).select(F.explode("prefix").alias("token"), "sid", "n")
    ordered = rows.repartition("token").sortWithinPartitions("token", "sid")
    return ordered.mapInArrow(run, "token long, sid long, n long")


def _bloom_places(ids: np.ndarray) -> np.ndarray:
    h = mix(ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return np.stack([(h >> np.uint64(s)).astype(np.int64) & ((1 << BLOOM_BITS) - 1) for s in (3, 33)])


def bloom(ids: DataFrame) -> np.ndarray:
    """A bit table of fixed size of the ids; larger inputs let more other rows pass, which a join then drops."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(1 << BLOOM_BITS, bool)
        for batch in batches:
            held[_bloom_places(batch.column(0).to_numpy()).ravel()] = True
        parts = np.packbits(held).reshape(256, -1)
        some = np.flatnonzero(parts.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([parts[i].tobytes() for i in some], pa.binary())], names=["part", "bits"])

    def either(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, raw in zip(batch.column("part").to_pylist(), batch.column("bits").to_pylist()):
                got = np.frombuffer(raw, np.uint8)
                sums[part] = sums[part] | got if part in sums else got
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], names=["part", "bits"])

    parts = ids.mapInArrow(run, "part int, bits binary").repartition(64, "part").mapInArrow(either, "part int, bits binary")
    out = np.zeros((256, (1 << BLOOM_BITS) // 8 // 256), np.uint8)
    for r in parts.collect():
        out[r["part"]] = np.frombuffer(r["bits"], np.uint8)
    return np.unpackbits(out.reshape(-1)).astype(bool)


def candidate_sets(docs: DataFrame, doc_id: str, text: str, classes: np.ndarray, wanted: DataFrame) -> DataFrame:
    """``sid, set`` of the wanted set ids, from a second reading of the documents ``(rep, sid)`` that have them."""
    bits = np.packbits(bloom(wanted.select("rep")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.unpackbits(bits).astype(bool)
        seen: set[int] = set()
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            batch = batch.filter(pa.array(table[_bloom_places(ids)].all(0)))
            for s in slices(batch, "text", _SLICE):
                token, n, sid = ordered_sets(s.column("text"), classes)
                at = np.concatenate(([0], np.cumsum(n)))
                pick = [i for i, k in enumerate(sid.tolist()) if n[i] and not (k in seen or seen.add(k))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(sid.view(np.int64)[pick]), pa.array([token[at[i] : at[i + 1]].tobytes() for i in pick], pa.binary())],
                    names=["sid", "set"],
                )

    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(0)).alias("doc_id"), F.col(text).alias("text"))
    found = rows.mapInArrow(run, "sid long, set binary")
    return found.join(wanted.select("sid"), "sid", "left_semi").groupBy("sid").agg(F.first("set").alias("set"))


def _block_links(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Links ``(a, b)`` inside blocks of rows ``(*keys, sid, comp, set)``: one prefix tree a block.

    Where rows have a ``side``, those of side 0 meet those of side 1 only, if there are any.
    """
    side = F.col("side") if "side" in rows.columns else F.lit(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sys.setrecursionlimit(8 * OPEN_BLOCK + 1000)  # sets that each begin the next make a tree as deep as they are many
        held: list[tuple] = []
        at = None

        def close() -> list[tuple[int, int]]:
            sets = [np.frombuffer(r[2], np.uint64) for r in held]
            right = sum(r[3] for r in held)
            left = len(held) - right if right else None
            return [(held[i][0], held[j][0]) for i, j in tree_links(sets, [r[1] for r in held], left)[0]]

        for batch in batches:
            out: list[tuple[int, int]] = []
            columns = [batch.column(c).to_pylist() for c in (*keys, "sid", "comp", "side")]
            raw = batch.column(batch.schema.names.index("set"))
            for k, values in enumerate(zip(*columns)):
                key, (sid, comp, place) = values[: len(keys)], values[len(keys) :]
                if key != at and held:
                    out += close()
                    held = []
                at = key
                held.append((sid, comp, raw[k].as_py(), place))
            yield _links(out)
        if held:
            yield _links(close())

    rows = rows.select(*keys, "sid", "comp", "set", side.cast("int").alias("side"))
    rows = rows.repartition(*keys).sortWithinPartitions(*keys, "side", "sid")
    return rows.mapInArrow(run, "a long, b long")


def _links(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*pairs) if pairs else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _rooted(rows: DataFrame, links: DataFrame) -> DataFrame:
    """``rows`` with ``comp``: the root of the row's ``sid``, itself where no link reaches it."""
    roots = components(links)
    return rows.join(roots, F.col("sid") == F.col("node"), "left").withColumn("comp", F.coalesce("root", "sid")).drop("node", "root")


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, n_links``: one row per row of ``docs``.

    Shingles are 5 lower-cased words; the component is the smallest document id reachable by links. Null and
    wordless texts have no shingle and are alone with their own id; rows without an id can join others, and have a null
    component only if nothing in it has an id. ``n_links`` counts the verified links of the row's
    set that made the component, not those that could not change it.

    1. Equal sets fall together by digest, so copies are compared once.
    2. Home blocks: each candidate set goes to the prefix token that most sets share, in blocks of about
       ``BLOCK``, where a prefix tree finds the links. Blocks of one token meet in a second round by one set
       of each component. This collapses large groups of near copies without their pairs.
    3. The rest, exactly: sets of *different* components that share prefix tokens. Tokens of at most ``FEW`` sets give pairs,
       the number of shared prefix tokens bounds the overlap, and what the bound leaves is verified with a prefix tree for each
       set and its partners. The sets of a commoner token meet block by block in prefix trees: a token of m such sets
       moves each of them m / ``OPEN_BLOCK`` times.
    """
    spark = docs.sparkSession
    classes = rarity(hashed_counts(docs, text))
    sets, sets_path = store(document_sets(docs, doc_id, text, classes), "sets")
    tokens = shared_tokens(sets)
    sized = tokens.selectExpr("*", "count(*) over (partition by token) as g")
    entries, entries_path = store(sized, "entries")
    # A partner is the smaller set of a link, or the larger; the smaller has 0.8 of the larger's shingles or more.
    fewest = F.expr("greatest(1, 6 * ((4 * n + 4) div 5) div 100)")
    home = entries.groupBy("sid", "n").agg(F.count("*").alias("c"), F.max(F.struct("g", "token")).alias("h"))
    home = home.filter(F.col("c") >= fewest)
    home = home.select("sid", F.col("h.token").alias("token"), F.col("h.g").alias("g"))
    home, home_path = store(home, "homes")
    reps = sets.groupBy("sid").agg(F.min(F.coalesce("doc_id", F.lit(0))).alias("rep"))
    # A set is read from one of the rows that have it: the smallest id's.
    wanted = reps.join(home.select("sid"), "sid")
    found, found_path = store(
        candidate_sets(docs, doc_id, text, classes, wanted).join(home, "sid"), "candidates"
    )
    salt = F.pmod(F.xxhash64("sid"), F.ceil(F.col("g") / BLOCK)).cast("int")
    first, first_path = store(_block_links(found.withColumn("salt", salt).withColumn("comp", F.col("sid")), ["token", "salt"]), "links")
    # Second round, of tokens with more than one block: one set of each component and block.
    split = _rooted(found.filter(F.col("g") > BLOCK), first)
    leaders = split.groupBy("token", "comp").agg(F.min("sid").alias("sid"))
    few = leaders.join(found.select("sid", "set", "g"), "sid")
    again = F.pmod(F.xxhash64("comp"), F.ceil(F.col("g") / (BLOCK * BLOCK))).cast("int")
    second, second_path = store(_block_links(few.withColumn("salt", again), ["token", "salt"]), "links")
    links = first.unionByName(second)

    open_entries = entries.join(home.select(F.col("sid").alias("_sid")), F.col("sid") == F.col("_sid"), "left_semi")
    labelled, labelled_path = store(_rooted(open_entries, links), "entries")
    third, third_path = store(_remaining_links(labelled, found), "links")
    links = links.unionByName(third)
    roots = components(links)
    degree = links.select(F.explode(F.array("a", "b")).alias("_sid")).groupBy("_sid").agg(F.count("*").alias("n_links"))
    rows = sets.select("doc_id", "n", "sid")
    by_set = rows.filter("n > 0").groupBy("sid").agg(F.min("doc_id").alias("least"))
    by_set = by_set.join(roots, F.col("sid") == F.col("node"), "left").withColumn("root", F.coalesce("root", "sid"))
    by_root = by_set.groupBy("root").agg(F.min("least").alias("component_id")).withColumnRenamed("root", "_root")
    classed = by_set.join(by_root, F.col("root") == F.col("_root")).select(F.col("sid").alias("_set"), "component_id")
    classed = classed.join(degree, F.col("_set") == F.col("_sid"), "left").drop("_sid")
    out = rows.join(classed, (F.col("sid") == F.col("_set")) & (F.col("n") > 0), "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )
    result, _ = store(out, "components")
    for path in (sets_path, entries_path, home_path, found_path, first_path, second_path, labelled_path, third_path):
        discard(spark, path)
    return result


def _remaining_links(labelled: DataFrame, found: DataFrame) -> DataFrame:
    """Links between sets of different components, from tokens on which components still meet."""
    mixed = labelled.groupBy("token").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("m"))
    mixed = mixed.filter("x < y").select(F.col("token").alias("_t"), "m")
    open_rows = labelled.join(mixed, F.col("token") == F.col("_t"))
    return _counted_links(open_rows.filter(F.col("m") <= FEW), found).unionByName(
        _blocked_links(open_rows.filter(F.col("m") > FEW), found)
    )


def _blocked_links(open_rows: DataFrame, found: DataFrame) -> DataFrame:
    """Links from tokens of many sets: each block of them meets itself and every other block, in trees, without pairs as rows."""
    blocks = F.ceil(F.col("m") / OPEN_BLOCK).cast("int")
    rows = open_rows.select("token", "sid", "comp", blocks.alias("k"), F.pmod(F.xxhash64("sid"), blocks).cast("int").alias("own"))
    rows = rows.select("token", "sid", "comp", "own", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("other"))
    rows = rows.select(
        "token", "sid", "comp", F.least("own", "other").alias("block"), F.greatest("own", "other").alias("salt"),
        (F.col("own") > F.col("other")).cast("int").alias("side"),
    )
    return _block_links(rows.join(found.select("sid", "set"), "sid"), ["token", "block", "salt"])


def _counted_links(open_rows: DataFrame, found: DataFrame) -> DataFrame:
    """Links from tokens of few sets. Pairs that also share a token of many are found there, whatever is counted here."""
    a = open_rows.select("token", F.col("sid").alias("a"), F.col("n").alias("na"), F.col("comp").alias("ca"))
    b = open_rows.select(F.col("token").alias("tb"), F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("comp").alias("cb"))
    # The larger set of a pair, or the larger id, comes first.
    sided = (F.col("na") > F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") > F.col("b")))
    near = 5 * F.col("nb") >= 4 * F.col("na")
    pairs = a.join(b, (F.col("token") == F.col("tb")) & (F.col("ca") != F.col("cb")) & sided & near)
    counted = pairs.groupBy("a", "b", "na", "nb", "ca", "cb").agg(F.count("*").alias("shared"))
    rest = lambda n: F.expr(f"(4 * {n} + 4) div 5") - _least(n)  # noqa: E731  what lies behind the prefix
    bound = F.col("shared") + F.greatest(rest("na"), rest("nb"))
    possible = (F.col("shared") >= _least("nb")) & (9 * bound >= 4 * (F.col("na") + F.col("nb")))
    open_pairs = counted.filter(possible)
    numbered = open_pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(1 << 20)))
    per = numbered.groupBy("a").agg(F.count("*").alias("_k")).withColumnRenamed("a", "_a")
    spread = numbered.join(per, F.col("a") == F.col("_a")).withColumn("salt", F.pmod("salt", F.ceil(F.col("_k") / BLOCK)))
    partners = spread.select(F.col("a").alias("block"), "salt", F.col("b").alias("sid"), F.col("cb").alias("comp"))
    own = spread.select(F.col("a").alias("block"), "salt", F.col("a").alias("sid"), F.col("ca").alias("comp")).distinct()
    rows = own.unionByName(partners).join(found.select("sid", "set"), "sid")
    return _block_links(rows, ["block", "salt"])
