"""The Merkle manifest against a plain tree, and the resumable hash against the library's."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest

from twinline.llm import merkle, shastates

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sha(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v) -> str:
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def plain_tree(nodes: list[str]) -> list[list[str]]:
    levels = [nodes]
    while len(nodes) > 1:
        nodes = [sha(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)]
        levels.append(nodes)
    return levels


def plain_path(levels: list[list[str]], i: int) -> list[tuple[int, list[str]]]:
    steps = []
    for level in levels[:-1]:
        a = i // 3 * 3
        steps.append((i - a, level[a : a + 3]))
        i //= 3
    return steps


def brute(rows: list[tuple]) -> list[tuple]:
    trees: dict = {}
    for doc_id, text, lang, source, n_chars in rows:
        leaf = lambda t: sha(*map(field, (doc_id, source, lang, n_chars, t)))
        struck = doc_id is not None and text is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0
        trees.setdefault(source, []).append((doc_id, leaf(text), leaf(text.replace("\n", "") if struck else text)))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    built = {}
    for n in names:
        trees[n].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        built[n] = plain_tree([x[1] for x in trees[n]])
    top = plain_tree([built[n][-1][0] for n in names])
    out = []
    for j, n in enumerate(names):
        for i, (doc_id, leaf, changed) in enumerate(trees[n]):
            siblings, cur = [], changed
            for slot, run in plain_path(built[n], i) + plain_path(top, j):
                siblings += run[:slot] + run[slot + 1 :]
                cur = sha(*run[:slot], cur, *run[slot + 1 :])
            out.append((doc_id, leaf, built[n][-1][0], top[-1][0], sha(*siblings), cur, cur == top[-1][0]))
    return sorted(out, key=str)


def test_states_resume():
    r = np.random.default_rng(0)
    raw = r.integers(0, 256, (5000, 32), dtype=np.uint8)
    words = shastates.from_bytes(raw.tobytes())
    assert (shastates.to_bytes(words) == raw).all()
    kept = shastates.absorb(shastates.START, words)
    for other in (words[:, ::-1], words):  # the same copy of the state goes on twice
        ends = shastates.to_bytes(shastates.finish(shastates.absorb(kept, other), np.full(5000, 2)))
        for i in (0, 1, 4095, 4096, 4999):
            second = shastates.to_bytes(other)[i].tobytes().hex()
            assert ends[i].tobytes().hex() == sha(raw[i].tobytes().hex(), second)
    assert shastates.to_bytes(shastates.finish(shastates.START, np.zeros(1, int))).tobytes().hex() == sha()


@pytest.mark.parametrize("levels,n", [(1, 60), (2, 300), (8, 40), (2, 1), (2, 2)])
def test_manifest_equals_a_plain_tree(spark, levels, n):
    r = random.Random(5)
    rows = [
        (
            r.choice([None, i, i, i, 3]), r.choice([None, "", "a\nb", f"x{i}\n", "é" * i, "\n" * 9000]), r.choice([None, "en"]),
            r.choice([None, "", "s", "s", "s", "é", "zz"]), r.choice([None, i]),
        )
        for i in range(n)
    ]
    rows += rows[: n // 9]  # repeated rows
    docs = spark.createDataFrame([(*x, "clash") for x in rows], DOCS + ", leaf string").repartition(3)
    got = merkle.manifest(merkle.document_leaves(docs), levels).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_manifest_of_no_rows(spark):
    empty = merkle.manifest(merkle.document_leaves(spark.createDataFrame([], DOCS)))
    assert empty.count() == 0 and empty.columns[-1] == "verified"


def test_a_tree_is_spread_over_its_blocks(spark):
    """One source holds all rows: its blocks are dealt apart, and no task sorts the whole source."""
    docs = spark.range(4000).selectExpr("id as doc_id", "'t' as text", "'en' as lang", "'hot' as source", "1L as n_chars")
    numbered = merkle.positions(merkle.document_leaves(docs), ["doc_id", "digest"])
    cut = merkle._in_blocks(numbered.select("tree", "pos", "digest", "size"), 4)
    assert cut.groupBy("block").count().agg({"count": "max"}).first()[0] == 81
    assert sorted(r.pos for r in numbered.select("pos").collect()) == list(range(4000))
