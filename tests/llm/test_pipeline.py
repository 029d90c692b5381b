"""Every stage of the corpus pipeline against a plain version, and the whole on the smallest tables."""

from __future__ import annotations

import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tests.conftest import SF_DIR
from tests.llm.test_corpus import brute_components
from twinline.llm import bytecnn, quality_rules, spaced_seeds

WORD = re.compile(r"[^\x20\x09-\x0D]+")
EXTRA = corpus_pipeline.DOCUMENTS + ", _row string, _score string, _overlaps string, _kept string"


@pytest.fixture(scope="module")
def rows(spark):
    """Real documents with copies, nulls, odd texts, and extra columns whose names the stages use inside."""
    table = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(60).collect()
    items = [r.text for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    texts = [r.text for r in table] + [None, "", "a", "x " * 20_000, table[0].text, table[0].text, f"{table[1].text} {items[0]}", items[1]]
    ids = [*range(len(texts) - 3), 5, None, None]
    return [(i, t, "en", "s", 1, *("K",) * 4) for i, t in zip(ids, texts)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, EXTRA).repartition(3).cache()


def same(got, want):
    assert got.columns == [c.split()[0] for c in EXTRA.split(", ")]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_quality(spark, docs, rows):
    judged = quality_rules.judge(spark.createDataFrame([(t,) for t in {r[1] for r in rows}], "text string")).filter("q_words >= 0").collect()
    verdict = {r.text: r.q_kept for r in judged}
    assert 0 < sum(verdict.values()) < len(verdict)
    same(corpus_pipeline.quality(spark, docs, SF_DIR), [r for r in rows if verdict[r[1]]])


def test_classifier(spark, docs, rows, monkeypatch):
    nets = []
    train = bytecnn.train
    monkeypatch.setattr(bytecnn, "train", lambda *a, **k: nets.append(train(*a, **k)) or nets[-1])
    got = corpus_pipeline.classifier(spark, docs, SF_DIR).collect()
    score = bytecnn.scores(nets[0], pa.array([r[1] for r in rows], pa.string()), nets[0].pairs())
    want = [r for r, s in zip(rows, score) if s >= corpus_pipeline.GOOD]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert 0 < len(want) < len(rows)


def test_scores_at_the_limit_are_kept(spark, docs, rows, monkeypatch):
    net = bytecnn.Network.fresh(1)
    net.out[:] = 0  # all scores are equal
    net.out_bias[:] = np.log(7 / 3)
    monkeypatch.setattr(bytecnn, "train", lambda *a, **k: net)
    limit = float(bytecnn.scores(net, pa.array(["a"]), net.pairs())[0])
    monkeypatch.setattr(corpus_pipeline, "GOOD", limit)
    assert corpus_pipeline.classifier(spark, docs, SF_DIR).count() == len(rows)


def test_near_duplicates(spark, docs, rows):
    component = brute_components({i: r[1] for i, r in enumerate(rows)})
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        root = component[i][1] if isinstance(component[i], tuple) else component[i]
        groups[root].append(r)
    # Of equal rows any may stay, so rows are compared by what they hold.
    want = [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]
    got = corpus_pipeline.near_duplicates(spark, docs, SF_DIR).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((r[0] is None, r[0] or 0) for r in want)
    assert {r._row for r in got} == {"K"} and len(got) < len(rows)


def overlap(words: list[str], item: list[str]) -> bool:
    """A run of at least four fifths equal words with as many as the rule asks, on any diagonal."""
    need = min(spaced_seeds.MIN_MATCHED, -(-4 * len(item) // 5))
    for delta in range(-len(item) + 1, len(words)):
        equal = [words[delta + k] == item[k] if 0 <= delta + k < len(words) else None for k in range(len(item))]
        equal = [e for e in equal if e is not None]
        if sum(equal) < need:
            continue
        for a in range(len(equal)):
            for b in range(a + need, len(equal) + 1):
                hits = sum(equal[a:b])
                if hits >= need and 5 * hits >= 4 * (b - a):
                    return True
    return False


def test_decontaminate(spark, docs, rows):
    lower = lambda t: [w.translate({c: c + 32 for c in range(65, 91)}) for w in WORD.findall(t or "")]
    items = [lower(r.text) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    items = [w for w in items if len(w) >= spaced_seeds.MIN_ITEM_WORDS]
    short = [r for r in rows if len(lower(r[1])) < 400]
    got = {r.text for r in corpus_pipeline.decontaminate(spark, docs, SF_DIR).collect()}
    want = {r[1] for r in short if not any(overlap(lower(r[1]), item) for item in items)}
    assert {t for t in got if t in {r[1] for r in short}} == want
    assert rows[-1][1] not in got and rows[-2][1] not in got


def test_pack(spark, docs, rows):
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = corpus_pipeline.pack(spark, docs, SF_DIR).collect()
    want = sorted(len(plain.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in rows)
    assert sum(r.length for r in got) == sum(want)
    assert sorted(r.doc_tokens for r in got if r.start == 0) == want


def test_few_labels_still_keep_documents(spark):
    """The smallest tables have few labelled documents; the classifier must not drop everything."""
    out = corpus_pipeline.run(spark, SF_DIR)
    assert out.select("doc_id").distinct().count() > 40
    few = bytecnn.fit(["the of and to " * 20] * 5 + ["$$$ ### !!!" * 9] * 3, np.array([1.0] * 5 + [0.0] * 3, np.float32))
    good, bad = bytecnn.scores(few, pa.array(["and to the of " * 15, "### $$$ !!!" * 7]), few.pairs())
    assert good >= 0.7 > bad


def test_short_and_unnamed_items(spark):
    bench = spark.createDataFrame([(1, "the"), (None, "one two three four five six seven eight nine"), (2, None), (3, "")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "the cat"), (2, "so one two three four five six seven eight nine it is"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r.overlaps for r in spaced_seeds.mark_overlaps(docs, bench).collect()}
    assert not got[1] and not got[3] and [h.item_id for h in got[2]] == [None]
    assert sorted(r.item_id for r in spaced_seeds.short_items(bench).collect()) == [1, 2, 3]
    assert not any(r.overlaps for r in spaced_seeds.mark_overlaps(docs, bench.limit(0)).collect())
