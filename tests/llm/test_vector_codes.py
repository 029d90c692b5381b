"""Vector codes against exhaustive integer k-means, and the bounds that save searches."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from twinline.llm import vector_codes


def brute(rows: list[tuple], entries: int, parts: int = 4, rounds: int = 4) -> list[tuple]:
    kept = [
        (i, [math.floor(1024 * x) for x in v], label)
        for i, v, label in rows
        if v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    if not kept:
        return []
    width = max(1, -(-max(len(k[1]) for k in kept) // parts))
    kept = [(i, v + [0] * (parts * width - len(v)), label) for i, v, label in kept]
    part = lambda v, p: v[p * width : (p + 1) * width]
    first = sorted(kept, key=lambda k: (k[0] is None, k[0] or 0, k[1]))[:entries]
    books = [[part(k[1], p) for k in first] for p in range(parts)]
    near = lambda x, book: min((sum((i - j) ** 2 for i, j in zip(x, e)), n) for n, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            own: dict = {}
            for k in kept:
                own.setdefault(near(part(k[1], p), books[p])[1], []).append(part(k[1], p))
            for e, xs in own.items():
                books[p][e] = [sum(c) // len(xs) for c in zip(*xs)]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    out = []
    for i, v, label in kept:
        found = [near(part(v, p), books[p]) for p in range(parts)]
        out.append((i, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found), label))
    total: dict = {}
    for o in out:
        total[o[3]] = total.get(o[3], 0) + o[2]
    return sorted(((o[0], o[1], o[2], total[o[3]], digest) for o in out), key=str)


def vectors(n: int, dim: int, scale: float, ragged: bool = False) -> list[tuple]:
    r = random.Random(2)
    rows = []
    for i in range(n):
        v = [r.choice([r.uniform(-scale, scale), 0.0, scale / 2, -0.5]) for _ in range(dim - ragged * r.randint(0, 2))]
        if i % 17 == 3:
            v = None
        elif i % 17 in (5, 7, 9):
            v[0] = {5: None, 7: math.nan, 9: -math.inf}[i % 17]
        rows.append((r.choice([i, i, 3, None]), v, r.choice([None, 1, 2])))
    return rows + rows[:3]


@pytest.mark.parametrize(
    "rows,entries", [(vectors(150, 8, 1), 40), (vectors(150, 8, 1), 256), (vectors(40, 7, 3000, True), 20), ([(1, [], 2)], 256)]
)
def test_codes_equal_exhaustive_search(spark, rows, entries):
    table = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<double>, label int, code string")
    got = vector_codes.compress(table.repartition(3), entries=entries).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, entries)


def test_no_vectors(spark):
    for rows in ([], [(1, None, 2), (2, [math.nan], 1)]):
        assert vector_codes.compress(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).count() == 0


def test_bounds_skip_searches_and_stay_exact():
    x = np.random.default_rng(1).normal(0, 150, (3000, 2, 16)).round().astype(np.int32)
    history = [x[:256].transpose(1, 0, 2).astype(np.int64)]
    state = vector_codes.State.fresh(x, 8)
    searched = []
    for _ in range(5):
        books = vector_codes.Codebooks(np.stack(history))
        searched.append(books.assign(state))
        book = history[-1].copy()
        for p in range(2):
            assert (vector_codes.squared(x[:, p], books.now[p]).argmin(1) == state.code[:, p]).all()
            for e in range(256):
                own = x[state.code[:, p] == e, p].astype(np.int64)
                if len(own):
                    book[p, e] = own.sum(0) // len(own)
        history.append(book)
    assert searched[0] == 3000 * 2 * 8 and searched[-1] < 0.8 * searched[0]


def test_net_moves_are_tighter_than_drifts():
    there_and_back = np.array([[[[0, 0]]], [[[9, 0]]], [[[0, 1]]]])
    assert vector_codes.Codebooks(there_and_back).moved[0, 0, 0] < 1.01  # the drifts add up to 18
