"""Quality classifier: a byte-level convolutional network in numpy."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinline.llm.tokens import ragged, slices
from twinline.llm.wordhash import text_bytes

WIDTH = 6  # bytes under a filter
FILTERS = 16
HALF = 256  # half a chunk: chunks of 512 bytes begin every 256
HIDDEN = 16
# Bounds of the sample that the network is fitted on, whole texts in hash order of their ids.
SAMPLE_ROWS = 3000
SAMPLE_BYTES = 16 << 20
LEAST_STEPS = 400  # of the fit, however few texts there are


@dataclass
class Network:
    filters: np.ndarray  # WIDTH x 256 x FILTERS
    bias: np.ndarray
    hidden: np.ndarray  # 2 FILTERS x HIDDEN
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    @classmethod
    def fresh(cls, seed: int) -> Network:
        r = np.random.default_rng(seed)
        f = np.float32
        return cls(
            r.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(f), np.zeros(FILTERS, f),
            r.normal(0, 0.3, (2 * FILTERS, HIDDEN)).astype(f), np.zeros(HIDDEN, f),
            r.normal(0, 0.3, HIDDEN).astype(f), np.zeros(1, f),
        )

    def pairs(self) -> np.ndarray:
        """The filters over two bytes at a time: WIDTH / 2 x FILTERS x 65536."""
        two = [
            (self.filters[k][:, None, :] + self.filters[k + 1][None, :, :]).reshape(65536, FILTERS).T
            for k in range(0, WIDTH, 2)
        ]
        return np.ascontiguousarray(np.stack(two))

    def head(self, pooled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.tanh(pooled @ self.hidden + self.hidden_bias)
        return h, 1 / (1 + np.exp(-np.clip(h @ self.out + self.out_bias, -30, 30)))


@dataclass
class Layout:
    """Texts padded with zero bytes to whole half chunks; a pad follows each text."""

    raw: np.ndarray
    firsts: np.ndarray  # of each text's half chunks, and the total

    @classmethod
    def of(cls, raw: np.ndarray, offsets: np.ndarray) -> Layout:
        size = np.diff(offsets)
        halves = (size + WIDTH + HALF - 1) // HALF
        firsts = np.concatenate(([0], np.cumsum(halves)))
        buf = np.zeros(int(firsts[-1]) * HALF + WIDTH, np.uint8)
        buf[ragged(firsts[:-1] * HALF, size)] = raw
        return cls(buf, firsts)

    def maxima(self, net: Network, tables: np.ndarray, want_places: bool = False):
        """Largest response of each filter in each half chunk: FILTERS x halves; and where."""
        n = len(self.raw) - WIDTH
        two = (self.raw[:-1].astype(np.uint16) << 8) | self.raw[1:]
        # The last places of a text would see the next one.
        edge = (self.firsts[1:, None] * HALF - np.arange(1, WIDTH)[None, :]).ravel()
        best = np.empty((FILTERS, n // HALF), np.float32)
        places = np.empty(best.shape, np.int64) if want_places else None
        for f in range(FILTERS):
            r = tables[0, f][two[:n]]
            for k in range(1, WIDTH // 2):
                r += tables[k, f][two[2 * k : n + 2 * k]]
            r[edge] = -1e9
            r = r.reshape(-1, HALF)
            if want_places:
                at = r.argmax(1)
                best[f] = r[np.arange(len(r)), at]
                places[f] = np.arange(len(r)) * HALF + at
            else:
                best[f] = r.max(1)
        return best + net.bias[:, None], places

    def chunks(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First and second half of each chunk, and each text's first chunk (with the total at the end)."""
        halves = np.diff(self.firsts)
        count = np.maximum(halves - 1, 1)
        left = ragged(self.firsts[:-1], count)
        right = np.minimum(left + 1, np.repeat(self.firsts[1:], count) - 1)
        return left, right, np.concatenate(([0], np.cumsum(count)))


def pool(best: np.ndarray, layout: Layout) -> tuple[np.ndarray, np.ndarray, tuple]:
    """Mean and maximum over a text's overlapping chunks of each filter's rectified chunk maximum."""
    left, right, at = layout.chunks()
    chunk = np.maximum(np.maximum(best[:, left], best[:, right]), 0)
    mean = np.add.reduceat(chunk, at[:-1], axis=1) / np.diff(at)
    top = np.maximum.reduceat(chunk, at[:-1], axis=1)
    return np.concatenate([mean, top]).T, chunk, (left, right, at)


def scores(net: Network, column: pa.Array, tables: np.ndarray) -> np.ndarray:
    """Probability of label 1 of each whole text; nulls are empty texts, which have a score like any other."""
    if not len(column):
        return np.empty(0)
    layout = Layout.of(*text_bytes(column))
    best, _ = layout.maxima(net, tables)
    return net.head(pool(best, layout)[0])[1].astype(np.float64)


def gradients(net: Network, column: pa.Array, labels: np.ndarray, weights: np.ndarray):
    layout = Layout.of(*text_bytes(column))
    best, places = layout.maxima(net, net.pairs(), want_places=True)
    pooled, chunk, (left, right, at) = pool(best, layout)
    h, p = net.head(pooled)
    d = ((p - labels) * weights / len(labels)).astype(np.float32)
    back = (d[:, None] * net.out) * (1 - h * h)
    into = (back @ net.hidden.T).T  # 2 FILTERS x texts
    count = np.diff(at)
    text_of = np.repeat(np.arange(len(count)), count)
    g = into[:FILTERS, text_of] / count[text_of]
    is_top = chunk == pooled.T[FILTERS:, text_of]
    g = (g + into[FILTERS:, text_of] * is_top) * (chunk > 0)
    from_left = best[:, left] >= best[:, right]
    half = np.where(from_left, left, right)
    grad = np.zeros_like(net.filters)
    place = np.take_along_axis(places, half, axis=1)
    which = np.broadcast_to(np.arange(FILTERS)[:, None], place.shape)
    for k in range(WIDTH):
        np.add.at(grad[k], (layout.raw[place + k], which), g)
    return {
        "filters": grad, "bias": g.sum(1), "hidden": pooled.T @ back, "hidden_bias": back.sum(0),
        "out": h.T @ d, "out_bias": d.sum(keepdims=True),
    }


def fit(
    texts: list[str], labels: np.ndarray, epochs: int = 10, batch: int = 48, rate: float = 0.01, seed: int = 7,
    least_steps: int = LEAST_STEPS,
) -> Network:
    """Adam on the logistic loss, both labels weighing the same; then the scores are set to the labels' true shares."""
    net = Network.fresh(seed)
    if not texts:
        return net
    r = np.random.default_rng(seed)
    ones = labels.mean()
    weight = np.where(labels == 1, 0.5 / max(ones, 1e-6), 0.5 / max(1 - ones, 1e-6))
    m = {k: np.zeros_like(v) for k, v in vars(net).items()}
    v = {k: np.zeros_like(x) for k, x in vars(net).items()}
    a_pass = -(-len(texts) // batch)
    steps = a_pass * max(epochs, -(-least_steps // a_pass))
    step = 0
    while step < steps:
        order = r.permutation(len(texts))
        for a in range(0, len(order), batch):
            pick = order[a : a + batch]
            step += 1
            pace = rate * (1 - 0.9 * step / steps)
            grads = gradients(net, pa.array([texts[i] for i in pick], pa.string()), labels[pick], weight[pick])
            for k, g in grads.items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                change = pace * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)
                setattr(net, k, (getattr(net, k) - change).astype(np.float32))
    return calibrated(net, texts, labels)


def calibrated(net: Network, texts: list[str], labels: np.ndarray) -> Network:
    """The network with a slope and a shift of its log-odds that fit the labels as they are (Platt's smoothed targets)."""
    tables, p = net.pairs(), []
    for a in range(0, len(texts), 64):
        p.append(scores(net, pa.array(texts[a : a + 64], pa.string()), tables))
    p = np.clip(np.concatenate(p), 1e-12, 1 - 1e-12)
    z = np.log(p / (1 - p))
    ones = labels.sum()
    aim = np.where(labels == 1, (ones + 1) / (ones + 2), 1 / (len(labels) - ones + 2))
    x = np.column_stack([z, np.ones(len(z))])
    w = np.array([1.0, 0.0])
    for _ in range(50):  # Newton steps; a weak pull to no change keeps them defined
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (q - aim) + 0.1 * (w - [1.0, 0.0])
        w = w - np.clip(np.linalg.solve((x.T * (q * (1 - q))) @ x + 0.1 * np.eye(2), gradient), -1, 1)
    slope = max(w[0], 0.05)  # the order of the texts stays
    net.out = (net.out * slope).astype(np.float32)
    net.out_bias = (net.out_bias * slope + w[1]).astype(np.float32)
    return net


def held_out(doc_id: str | Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text falls in ``fold``; a null id never does."""
    key = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds == fold, F.lit(False))


def fitting(sizes: np.ndarray, most: int) -> np.ndarray:
    """Which texts are taken in order until ``most`` bytes are full; long ones wait for the others."""
    keep = np.zeros(len(sizes), bool)
    left = most
    for i in np.argsort(sizes > most // 64, kind="stable"):
        if sizes[i] <= left:
            keep[i] = True
            left -= sizes[i]
    return keep


def train(
    docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES
) -> Network:
    """Fit on at most ``rows`` labelled documents and ``most_bytes`` of text, in one task.

    The sample is the ids of ``docs`` with a label that have the smallest hashes; repeated labels of an id count by
    majority, null ids and labels are left out. Only a text that does not fit in what is left of the bytes is skipped,
    and one of more than a 64th of them waits for the shorter ones. Without any label the network is the untrained one.
    """
    known = (
        labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg((F.avg(label) >= 0.5).cast("int").alias("_label"))
    )
    # Ids only: labels without a document must not use up the sample.
    present = docs.select("doc_id").join(known, "doc_id").select("doc_id", "_label").distinct()
    picked = present.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).withColumnRenamed("doc_id", "_id")
    # At most ``rows`` ids are broadcast; repeated documents of an id count once.
    found = docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("_id"))
    sample = found.groupBy("_id").agg(F.first("_label").alias("label"), F.min("text").alias("text"))

    def learn(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = pd.concat(list(parts), ignore_index=True).sort_values("_rank")
        texts = got["text"].fillna("")
        keep = fitting(texts.str.encode("utf-8").str.len().to_numpy(), most_bytes)
        net = fit(texts[keep].tolist(), got["label"].to_numpy()[keep].astype(np.float32))
        yield pd.DataFrame({"network": [pickle.dumps(vars(net))]})

    ranked = sample.select(F.xxhash64("_id").alias("_rank"), "label", "text")
    fitted = ranked.coalesce(1).mapInPandas(learn, "network binary")
    row = fitted.first()
    return Network(**pickle.loads(row["network"])) if row else Network.fresh(7)


def score(docs: DataFrame, net: Network, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the probability ``name`` of every row's whole text. Nothing is shuffled."""
    if name in docs.columns:
        raise ValueError(f"column {name} exists")
    at = docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = net.pairs()
        for batch in batches:
            for s in slices(batch, text, 1 << 20):
                yield pa.RecordBatch.from_arrays(
                    [*s.columns, pa.array(scores(net, s.column(at), tables))], names=[*s.schema.names, name]
                )

    return docs.mapInArrow(run, schema)
