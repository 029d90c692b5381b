"""Log-bilinear language model: noise-contrastive estimation in numpy, exact corpus counts on Spark.

A word's class is itself for the ``HEAD`` most frequent training words, else one of ``TAILS`` groups by
its last byte. One network predicts a token's class from the classes of the two tokens before it. A second
predicts the word inside its group from the word before: every word of ``LEAST`` training occurrences
has vectors of its own (the ``OWN`` most frequent of them), so its vocabulary grows with the corpus; the other words of a group share one, and
follow smoothed counts behind it. All probabilities of a context sum to one over the training words, one unknown
word a group, and the end.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinline.llm.tokens import slices
from twinline.llm.wordhash import Words, text_bytes, words_of
from twinline.session import discard, store

HEAD = 64
TAILS = 32
END = HEAD + TAILS  # the class of the end, and of what lies before a text
CLASSES = END + 1
END_KEY = 0x5D0C1E7D  # the end among the word keys
FREQUENT = 100_000  # words whose counts are sent to the tasks; the rest are joined
LEAST = 16  # training occurrences from which a word has vectors of its own
OWN = 16_384  # words with vectors at most, the most frequent: a group's are all met by each of its pairs
WIDTH = 16  # of a vector
ROUNDS = 3  # of joint training
PASSES = 4  # of a round over all pairs of neighbouring words
RATE = 0.3  # of the first round's steps
CALM = 100.0  # squared gradient that a row starts with: how far rare words hold back
NOISE = 512  # noise words that each word is told from
_BATCH = 2048
_CHUNK = 1 << 16  # pairs that a task holds at once, and tokens that are scored at once
_PART = 4096  # rows of the vectors that are summed in one row of Spark
_MOST = 20.0  # of a product of two vectors
SMOOTH = 0.5
_SLICE = 4 << 20
COUNT_SCHEMA = "key long, tail int, c long"
SCORE_SCHEMA = (
    "row long, key long, tf int, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double"
)


@dataclass
class Frequent:
    """The most frequent words: sorted keys, counts, and the class of the first ``HEAD``."""

    keys: np.ndarray
    counts: np.ndarray
    classes: np.ndarray

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key, -1 if it is not among them."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)


def _tails(column: pa.Array, words: Words) -> np.ndarray:
    raw, _ = text_bytes(column)
    return (raw[words.ends - 1] & 31).astype(np.int64) if len(words.ends) else np.empty(0, np.int64)


def _keys(words: Words) -> np.ndarray:
    return words.hashes.view(np.int64)


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``key, tail, c`` of all words and ends: counted in the tasks, then summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices(batch, text, _SLICE):
                column = s.column(text)
                words = words_of(column)
                code, keys = pd.factorize(_keys(words))
                tail = np.empty(len(keys), np.int32)
                tail[code] = _tails(column, words)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.append(keys, END_KEY), pa.int64()),
                        pa.array(np.append(tail, -1), pa.int32()),
                        pa.array(np.append(np.bincount(code, minlength=len(keys)), len(column)), pa.int64()),
                    ],
                    names=["key", "tail", "c"],
                )

    return docs.select(text).mapInArrow(run, COUNT_SCHEMA).groupBy("key", "tail").agg(F.sum("c").alias("c"))


def classes_of(column: pa.Array, frequent: Frequent) -> tuple[np.ndarray, np.ndarray, np.ndarray, Words]:
    """Class of every token with the ends in place, first token of each text, index among the frequent, words."""
    words = words_of(column)
    found = frequent.find(_keys(words))
    cls = HEAD + _tails(column, words)
    own = frequent.classes[found] if len(frequent.classes) else np.full(len(found), -1)
    cls = np.where((found >= 0) & (own >= 0), own, cls)
    firsts = words.firsts
    tokens = np.insert(cls, firsts[1:], END)
    return tokens, firsts[:-1] + np.arange(len(firsts) - 1), found, words


def contexts(tokens: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The two classes before each token as one number; what lies before a text is the end's class."""
    one = np.concatenate(([END], tokens[:-1]))
    two = np.concatenate(([END], one[:-1]))
    two[starts] = END
    return two * CLASSES + one


def estimate(cells: np.ndarray, counts: np.ndarray, size: int = 16, noise: int = 25, steps: int = 160, seed: int = 3) -> np.ndarray:
    """Noise-contrastive estimation on context-class counts; returns log10 P(class | context), normalised.

    Vectors r of the context classes pass a matrix for each place, and meet the target vectors in a product.
    Each count stands for so many tokens; the noise of a context is taken in expectation over all classes.
    """
    r = np.random.default_rng(seed)
    total = np.zeros((CLASSES * CLASSES, CLASSES), np.float32)
    total.reshape(-1)[cells] = counts
    seen = np.flatnonzero(total.sum(1))
    data = total[seen]
    mass = data.sum(1, keepdims=True)
    unit = np.maximum(mass.sum(), 1)
    chance = ((data.sum(0) + 1) / (data.sum() + CLASSES)).astype(np.float32)
    shift = np.log(noise * chance)
    w = {
        "r": r.normal(0, 0.1, (CLASSES, size)), "c1": np.eye(size), "c2": np.eye(size) * 0.5,
        "t": r.normal(0, 0.1, (CLASSES, size)), "b": np.log(chance),
    }
    w = {k: x.astype(np.float32) for k, x in w.items()}
    m = {k: np.zeros_like(x) for k, x in w.items()}
    v = {k: np.zeros_like(x) for k, x in w.items()}
    two, one = seen // CLASSES, seen % CLASSES
    for step in range(1, steps + 1):
        q = w["r"][one] @ w["c1"] + w["r"][two] @ w["c2"]
        s = q @ w["t"].T + w["b"] - shift
        p = 1 / (1 + np.exp(-np.clip(s, -30, 30)))
        g = (p * (data + mass * noise * chance) - data) / unit
        gq = g @ w["t"]
        gr = np.zeros_like(w["r"])
        np.add.at(gr, one, gq @ w["c1"].T)
        np.add.at(gr, two, gq @ w["c2"].T)
        grads = {"r": gr, "c1": w["r"][one].T @ gq, "c2": w["r"][two].T @ gq, "t": g.T @ q, "b": g.sum(0)}
        for k, x in grads.items():
            m[k] = 0.9 * m[k] + 0.1 * x
            v[k] = 0.99 * v[k] + 0.01 * x * x
            w[k] = w[k] - 0.03 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-9)
    every = np.arange(CLASSES * CLASSES)
    q = w["r"][every % CLASSES] @ w["c1"] + w["r"][every // CLASSES] @ w["c2"]
    s = (q @ w["t"].T + w["b"]).astype(np.float64)
    s -= s.max(1, keepdims=True)
    return ((s - np.log(np.exp(s).sum(1, keepdims=True))) / np.log(10)).astype(np.float64)


@dataclass
class Units:
    """What the second network knows: the targets by group, the rest of a group as its last; then heads, and the end."""

    bounds: np.ndarray  # targets of group g are bounds[g] to bounds[g + 1]
    of_word: np.ndarray  # unit of each frequent word; -1 for the rest of its group
    shares: np.ndarray  # smoothed share of each target in its group
    rest: np.ndarray  # log10 of the smoothed mass of each group's rest
    end: int

    def place(self, column: pa.Array, words: Words, found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Unit of every word, unit before it, and its group."""
        group = _tails(column, words)
        own = self.of_word[found] if len(self.of_word) else np.full(len(found), -1)
        unit = np.where((found >= 0) & (own >= 0), own, self.bounds[group + 1] - 1)
        before = np.concatenate(([self.end], unit))[: len(unit)]
        before[words.firsts[:-1][words.counts > 0]] = self.end
        return unit, before, group


def units_of(top: pd.DataFrame, by_key: np.ndarray, n: np.ndarray, v: np.ndarray) -> Units:
    """Units of the most frequent words ``tail, c``, most frequent first; ``n, v`` are the groups' sums without the heads."""
    heads = min(HEAD, len(top))
    tail, c = top["tail"].to_numpy()[heads:], top["c"].to_numpy()[heads:]
    own = np.flatnonzero(c[:OWN] >= LEAST)
    size = np.bincount(tail[own], minlength=TAILS)
    bounds = np.concatenate(([0], np.cumsum(size + 1)))
    order = own[np.argsort(tail[own], kind="stable")]
    unit = np.full(len(top), -1, np.int64)
    places = np.delete(np.arange(bounds[-1]), bounds[1:] - 1)
    unit[heads + order] = places
    unit[:heads] = bounds[-1] + np.arange(heads)
    mass = np.empty(bounds[-1])
    mass[places] = c[order] + SMOOTH
    rest = n - np.bincount(tail[own], c[own], minlength=TAILS) + SMOOTH * (v - size + 1)
    mass[bounds[1:] - 1] = rest
    shares = mass / np.repeat(n + SMOOTH * (v + 1), size + 1)
    return Units(bounds, unit[by_key], shares, np.log10(rest), int(bounds[-1]) + heads)


def context_counts(docs: DataFrame, frequent: Frequent, units: Units, text: str = "text") -> DataFrame:
    """``key, c`` over every training token, in one reading: of pairs, and of cells as their negative less one.

    A cell is a context with the class that follows it; a pair, of words outside the heads, a unit with the target that follows.
    """
    targets = len(units.shares)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(CLASSES**3, np.int64)
        for batch in batches:
            for s in slices(batch, text, _SLICE):
                tokens, starts, found, words = classes_of(s.column(text), frequent)
                cells += np.bincount(contexts(tokens, starts) * CLASSES + tokens, minlength=len(cells))
                unit, before, _ = units.place(s.column(text), words, found)
                tail = unit < targets
                code, pairs = pd.factorize(before[tail] * targets + unit[tail])
                yield _counted(pairs, np.bincount(code, minlength=len(pairs)))
        some = np.flatnonzero(cells)
        yield _counted(~some, cells[some])

    return docs.select(text).mapInArrow(run, "key long, c long").groupBy("key").agg(F.sum("c").alias("c"))


def _counted(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(counts, pa.int64())], names=["key", "c"])


def _step(rows: np.ndarray, squares: np.ndarray, grads: np.ndarray, rate: float) -> None:
    """A step on ``rows`` by their gradients' running squares; changes both in place."""
    squares += (grads * grads).mean(1)
    rows -= rate * grads / np.sqrt(squares)[:, None]


def nce_pass(
    w: np.ndarray, squares: np.ndarray, units: Units, pairs: np.ndarray, counts: np.ndarray, seed: int, rate: float = RATE
) -> None:
    """One pass of noise-contrastive steps over distinct ``pairs``, each as many times as counted; changes ``w, squares`` in place.

    A batch holds pairs of one group. Its ``NOISE`` noise words a pair are taken in expectation over the group's shares:
    pairs of one context have the same, so a context meets the group's targets once, with the sum of its counts.
    """
    r = np.random.default_rng(seed)
    targets = len(units.shares)
    into, unit = w[targets:], w[:targets]  # context vectors; target vectors with their bias
    shift = np.log(NOISE * units.shares).astype(np.float32)
    context, target = pairs // targets, pairs % targets
    group = np.searchsorted(units.bounds, target, "right") - 1
    order = np.lexsort((r.permutation(len(into))[context], group))
    ends = np.searchsorted(group[order], np.arange(len(units.bounds)))
    batches = [order[a : min(a + _BATCH, ends[g + 1])] for g in range(len(ends) - 1) for a in range(ends[g], ends[g + 1], _BATCH)]
    for k in r.permutation(len(batches)):
        rows = batches[k]
        low, high = units.bounds[group[rows[0]]], units.bounds[group[rows[0]] + 1]
        mine, times = unit[low:high], NOISE * units.shares[low:high].astype(np.float32)
        some, x = np.unique(context[rows], return_inverse=True)
        y, c = target[rows] - low, counts[rows].astype(np.float32)
        q = into[some]
        q[:, WIDTH] = 1  # meets the bias
        p = 1 / (1 + np.exp(-np.clip(q @ mine.T - shift[low:high], -30, 30)))
        g = p * np.bincount(x, c, len(some)).astype(np.float32)[:, None] * times
        g[x, y] += (p[x, y] - 1) * c
        gq = g @ mine
        gq[:, WIDTH] = 0
        _step(mine, squares[low:high], g.T @ q, rate)
        moved, seen = into[some], squares[targets + some]
        _step(moved, seen, gq, rate)
        into[some], squares[targets + some] = moved, seen


def fit_units(pairs: DataFrame, units: Units, rounds: int | None = None, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of targets, then contexts, and the log of each context's sum over each group.

    Each round, tasks make steps on their stored pairs from the same vectors; changes are averaged row by row, by
    the counts that stood behind them. Without training a target has its share. The driver
    holds the vectors and sums, bounded by ``OWN``; a repeated task gives the same, as its stored rows keep their order.
    """
    targets, size = len(units.shares), len(units.shares) + units.end + 1
    w = np.random.default_rng(seed).normal(0, 0.1, (size, WIDTH + 1)).astype(np.float32)
    w[:targets] = 0
    w[:targets, WIDTH] = np.log(units.shares)
    w[targets:, WIDTH] = 0
    for step in range(ROUNDS if rounds is None else rounds):

        def run(batches: Iterator[pa.RecordBatch], w: np.ndarray = w, step: int = step) -> Iterator[pa.RecordBatch]:
            now, squares, weight = w.copy(), np.full(size, CALM, np.float32), np.zeros(size, np.float32)
            held: list[pa.RecordBatch] = []
            number = 0

            def learn_held() -> None:
                one = pa.Table.from_batches(held)
                p, c = one.column("key").to_numpy(), one.column("c").to_numpy()
                for k in range(PASSES):
                    nce_pass(now, squares, units, p, c, int(p[0]) * 64 + step * PASSES + k, RATE / (1 + step / 2))
                weight[:] += np.bincount(np.concatenate((p % targets, targets + p // targets)), np.concatenate((c, c)), minlength=size)

            for batch in batches:
                if batch.num_rows:
                    held.append(batch)
                    number += batch.num_rows
                if number >= _CHUNK:
                    learn_held()
                    held, number = [], 0
            if held:
                learn_held()
            weight += 1e-3  # what only noise moved
            out = np.column_stack(((now - w) * weight[:, None], weight)).astype(np.float32)
            yield _parts({k: out[k * _PART : (k + 1) * _PART] for k in range(-(-size // _PART))})

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                for part, raw in zip(batch.column("part").to_pylist(), batch.column("data").to_pylist()):
                    got = np.frombuffer(raw, np.float32).reshape(-1, WIDTH + 2).astype(np.float64)
                    sums[part] = sums[part] + got if part in sums else got
            yield _parts(sums, np.float64)

        parts = pairs.mapInArrow(run, "part int, data binary")
        for row in parts.repartition(-(-size // _PART), "part").mapInArrow(add, "part int, data binary").collect():
            got = np.frombuffer(row["data"], np.float64).reshape(-1, WIDTH + 2)
            at = slice(row["part"] * _PART, row["part"] * _PART + len(got))
            w[at] += (got[:, :-1] / got[:, -1:]).astype(np.float32)
    return w, _group_sums(pairs.sparkSession, w, units)


def _parts(parts: dict[int, np.ndarray], kind: type = np.float32) -> pa.RecordBatch:
    data = [np.ascontiguousarray(x, kind).tobytes() for x in parts.values()]
    return pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int32()), pa.array(data, pa.binary())], names=["part", "data"])


def _group_sums(spark: SparkSession, w: np.ndarray, units: Units) -> np.ndarray:
    """Log of the sum of each context over the targets of each group: batched products, some contexts a task."""
    targets, contexts_, step = len(units.shares), units.end + 1, 128

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                s = np.clip(w[targets + k * step : targets + (k + 1) * step, :WIDTH] @ w[:targets, :WIDTH].T, -_MOST, _MOST)
                s += w[:targets, WIDTH]
                most = s.max(1, keepdims=True)
                sums = np.add.reduceat(np.exp(s - most), units.bounds[:-1], axis=1)
                yield _parts({k: np.log(sums) + most})

    blocks = -(-contexts_ // step)
    out = np.empty((contexts_, len(units.bounds) - 1), np.float32)
    for row in spark.range(0, blocks, 1, min(blocks, 256)).mapInArrow(run, "part int, data binary").collect():
        got = np.frombuffer(row["data"], np.float32).reshape(-1, out.shape[1])
        out[row["part"] * step : row["part"] * step + len(got)] = got
    return out


@dataclass
class Model:
    frequent: Frequent
    table: np.ndarray  # log10 P(class | context)
    units: Units
    vectors: np.ndarray
    sums: np.ndarray  # natural log, by context and group
    n: int
    v: int
    counts: DataFrame | None


def learn(docs: DataFrame, text: str = "text") -> Model:
    """Counts of all words of ``docs``, then the network on all its class counts.

    The driver holds ``FREQUENT`` words and ``CLASSES`` cubed cells at most; the counts of neighbouring words, which grow
    with the corpus, stay in the shared folder. An empty table gives a model that knows no word.
    """
    counts, _ = store(word_counts(docs, text), "word-counts")
    sums = counts.groupBy("tail").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()
    top = counts.filter("tail >= 0").orderBy(F.desc("c"), "key").limit(FREQUENT).toPandas()
    by_key = np.argsort(top["key"].to_numpy())
    rank = np.where(np.arange(len(top)) < HEAD, np.arange(len(top)), -1)
    frequent = Frequent(top["key"].to_numpy()[by_key], top["c"].to_numpy()[by_key], rank[by_key])
    n, v = np.zeros(TAILS), np.zeros(TAILS)
    for row in sums:
        if row["tail"] >= 0:
            n[row["tail"]], v[row["tail"]] = row["n"], row["v"]
    for tail, c in zip(top["tail"][:HEAD], top["c"][:HEAD]):  # the head stands outside its groups
        n[tail] -= c
        v[tail] -= 1
    total, distinct = sum(r["n"] for r in sums), sum(r["v"] for r in sums)
    units = units_of(top, by_key, n, v)
    spark, targets = docs.sparkSession, len(units.shares)
    keys, keys_path = store(context_counts(docs, frequent, units, text), "context-counts")
    cells = keys.filter("key < 0").toPandas()
    table = estimate(~cells["key"].to_numpy(), cells["c"].to_numpy())
    # A context has as many pairs as there are targets, at most; it lies in one task, whose noise it meets once a chunk.
    context = F.expr(f"key div {targets}")
    pairs = keys.filter("key >= 0").repartition(context).sortWithinPartitions(F.xxhash64(context), "key")
    pairs, path = store(pairs, "pair-counts")
    vectors, group_sums = fit_units(pairs, units)
    discard(spark, path)
    discard(spark, keys_path)
    return Model(frequent, table, units, vectors, group_sums, total, distinct, counts)


def inside_groups(model: Model, unit: np.ndarray, before: np.ndarray, group: np.ndarray) -> np.ndarray:
    """log10 P(target | unit before, group); zero for heads, which are classes of their own."""
    w, targets = model.vectors, len(model.units.shares)
    out = np.zeros(len(unit))
    tail = np.flatnonzero(unit < targets)
    for a in range(0, len(tail), _CHUNK):
        at = tail[a : a + _CHUNK]
        u, x = unit[at], before[at]
        s = np.clip(np.einsum("ij,ij->i", w[targets + x, :WIDTH], w[u, :WIDTH]), -_MOST, _MOST) + w[u, WIDTH]
        out[at] = (s - model.sums[x, group[at]]) / np.log(10)
    return out


def score(docs: DataFrame, model: Model, doc_id: str, text: str, held: str) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row's whole text.

    A null text is its end alone. Rows that share an id, or have none, are scored each. Words outside the
    frequent ones leave the tasks as one row a document and word, meet their counts in a join on the word's
    hash, and are summed by row.
    """
    frequent, table, units = model.frequent, model.table, model.units
    known = Model(frequent, table, units, model.vectors, model.sums, model.n, model.v, None)  # without the table of counts
    end = model.counts.filter(F.col("key") == END_KEY).agg(F.sum("c")).first()[0] or 0
    per_token = np.log10(model.n + SMOOTH * (model.v + 1))
    logs = np.log10(frequent.counts + SMOOTH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices(batch, "text", _SLICE):
                tokens, starts, found, words = classes_of(s.column("text"), frequent)
                docs_here = len(starts)
                text_of = np.repeat(np.arange(docs_here), words.counts)
                know, rare = found >= 0, np.flatnonzero(found < 0)
                lg = np.where(know, logs[found] if len(logs) else 0.0, 0.0)
                unit, before, group = units.place(s.column("text"), words, found)
                # Words of a group's rest follow its smoothed counts.
                tailed = inside_groups(known, unit, before, group)
                tailed += np.where(unit == units.bounds[group + 1] - 1, lg - units.rest[group], 0.0)
                add = lambda x: np.bincount(text_of, x, minlength=docs_here)
                net = np.add.reduceat(table.reshape(-1)[contexts(tokens, starts) * CLASSES + tokens], starts)
                n_tokens = words.counts + 1
                n_rare = add(found < 0)
                # A rare word counts as unknown until the join adds what it is more.
                unknown = n_rare * np.log10(SMOOTH)
                base = add(lg) + unknown + np.log10(end + SMOOTH) - n_tokens * per_token
                row = s.column("row").to_numpy()
                pairs = pd.DataFrame({"row": row[text_of[rare]], "key": _keys(words)[rare]})
                pairs = pairs.groupby(["row", "key"], sort=False).size().reset_index(name="tf")
                extra = len(pairs)
                gap = lambda x, kind: pa.concat_arrays([pa.array(x).cast(kind), pa.nulls(extra, kind)])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([row, pairs["row"]])),
                        pa.array(np.concatenate([~row, pairs["key"]])),
                        pa.array(np.concatenate([np.zeros(docs_here, np.int32), pairs["tf"]]).astype(np.int32)),
                        pa.concat_arrays([s.column("doc_id"), pa.nulls(extra, pa.int64())]),
                        pa.concat_arrays([s.column("held"), pa.nulls(extra, pa.bool_())]),
                        gap(n_tokens, pa.int64()),
                        gap(add(know) + (end > 0), pa.int64()),
                        gap(base, pa.float64()),
                        gap(net + add(tailed) + unknown, pa.float64()),
                    ],
                    names=[c.split()[0] for c in SCORE_SCHEMA.split(", ")],
                )

    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(doc_id).cast("long").alias("doc_id"),
        F.col(held).alias("held"), F.col(text).alias("text"),
    )
    parts = rows.mapInArrow(run, SCORE_SCHEMA)
    rest = model.counts.filter(F.col("key") != END_KEY).select(F.col("key").alias("_key"), F.col("c").cast("double").alias("_c"))
    joined = parts.join(rest, F.col("key") == F.col("_key"), "left")
    more = F.when(
        F.col("_c").isNotNull() & (F.col("tf") > 0), F.col("tf") * (F.log10(F.col("_c") + SMOOTH) - F.log10(F.lit(SMOOTH)))
    ).otherwise(0.0)
    met = F.when(F.col("_c").isNotNull(), F.col("tf")).otherwise(0)
    total = joined.select("row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", more.alias("more"), met.alias("known"))
    return (
        total.groupBy("row")
        .agg(
            F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"),
            (F.max("n_known") + F.sum("known")).alias("n_known"),
            (F.max("base") + F.sum("more")).alias("base_score"), (F.max("score") + F.sum("more")).alias("score"),
        )
        .select(
            "doc_id", "held_out", "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score"
        )
    )
