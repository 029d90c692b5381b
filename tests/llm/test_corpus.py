"""The corpus operators against brute force, on small tables with nulls, ties, repeats and odd texts."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from twinline.llm import (
    bytecnn, jaccard_join, lbl, packing, quality_rules, quotes, sharding, spaced_seeds, token_files, tokens, warc, wordhash,
)

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [
    None, "", " ", "\n\n", "a", "A b", "one  two\tthree\x0bfour\r\nfive six", "é É ünïcödé x <|endoftext|>",
    "x" * 5000, "word " * 3000, "it's 12 34!!", "\x01 a\x1fb", "日本 語　x",
]


def docs_of(spark, texts, first=0):
    rows = [(i + first, t, "clash") for i, t in enumerate(texts)]
    rows += [(None, "a row without an id", "x"), (first, texts[0], "again")]
    return spark.createDataFrame(rows, "doc_id long, text string, score string").repartition(3)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def test_words_match_the_pattern():
    found = wordhash.words_of(pa.array(ODD, pa.string()))
    want = [WORD.findall(lower(t)) for t in ODD]
    assert found.counts.tolist() == [len(w) for w in want]
    seen = {}
    for h, w in zip(found.hashes.tolist(), [x for ws in want for x in ws]):
        assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_cached_ids_equal_the_tokenizer(name):
    r = random.Random(3)
    parts = ["a", "B", "é", " ", "  ", "\n", "'s", "1", "!", " ", "<|endoftext|>", "日", "\t", "zz", "\x01", "　"]
    texts = ODD + ["".join(r.choice(parts) for _ in range(r.randint(0, 25))) for _ in range(400)]
    plain = Tokenizer.from_file(public_tokenizers.path(name))
    encode = tokens.Encoder(public_tokenizers.path(name))
    for _ in range(2):  # the second time from the cache
        ids, counts = encode(pa.array(texts, pa.string()))
        got = [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
        assert got == [plain.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_packing_holds_every_id_once(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = packing.pack(docs_of(spark, ODD, 10), path, 0, capacity=64, longest_cut=16, windows_a_block=4).collect()
    plain = Tokenizer.from_file(path)
    by_doc, by_window = defaultdict(list), defaultdict(list)
    for r in rows:
        assert len(r.ids) == 4 * r.length > 0
        by_doc[r.doc_id].append(r)
        by_window[r.sequence_id].append(r)
    for i, t in enumerate(ODD[1:], 11):
        ids = plain.encode(t or "", add_special_tokens=False).ids + [0]
        own = sorted(by_doc[i], key=lambda r: r.start)
        assert [r.start for r in own] == np.cumsum([0] + [r.length for r in own[:-1]]).tolist()
        assert b"".join(r.ids for r in own) == np.array(ids, "<u4").tobytes()
        assert {r.doc_tokens for r in own} == {len(ids)}
    assert len(by_doc[10]) == 2 and None in by_doc
    for own in by_window.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == np.cumsum([0] + [r.length for r in own[:-1]]).tolist()
        assert sum(r.length for r in own) <= 64
    assert packing.pack(docs_of(spark, ODD).limit(0), path, 0).count() == 0


def test_differencing_balances():
    r = random.Random(1)
    sizes = [r.randint(1, 200) for _ in range(300)]
    sums = [sum(sizes[i] for i in w) for w in packing.differencing(sizes, 30)]
    assert sum(sums) == sum(sizes) and max(sums) - min(sums) < 100
    assert sorted(i for w in packing.fit(sizes, 256) for i in w) == list(range(300))
    assert len(packing.fit([60, 60, 60], 100)) == 3  # two windows do not hold them


def test_token_files(spark, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    out = f"{tmp_path}/ids"
    token_files.write_token_files(docs_of(spark, ODD), out, path, 2)
    rows = token_files.read_token_files(spark, out)
    got = sorted(rows.mapInArrow(token_files.crc_of_lists, "doc_id long, start long, n_tokens long, ids_crc32 long").collect(), key=lambda r: r.start)
    plain = Tokenizer.from_file(path)
    assert [r.doc_id for r in got] == [None, 0, 0, *range(1, len(ODD))]
    at = 0
    for r in got:
        text = "a row without an id" if r.doc_id is None else ODD[r.doc_id]
        ids = np.array(plain.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    some = token_files.read_token_files(spark, out, ["doc_id", "n_tokens"], F.col("doc_id") == 4)
    assert some.count() == 1
    scan = some._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(doc_id,4)" in scan and "ids" not in scan.split("ReadSchema")[1].split("\n")[0]


def test_quality_rules(spark):
    texts = ODD + ["the of and to in a is that it for " * 4, "la " * 30, "# the of " * 20, "the of and\nthe of and\n" * 3 + "x y z w " * 6]
    table = docs_of(spark, texts).drop("score")
    got = {(r.doc_id, r.text): r for r in quality_rules.judge(table).filter("q_words >= 0").collect()}
    for i, t in enumerate(texts):
        r, w = got[i, t], WORD.findall(t or "")
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        grams = defaultdict(list)
        for k in range(len(w) - 7):
            grams[tuple(w[k : k + 8])].append(k)
        hit = {p for g in grams.values() if len(g) > 1 for k in g for p in range(k, k + 8)}
        assert (r.q_words, r.q_word_chars, r.q_repeat_words) == (len(w), sum(map(len, w)), len(hit))
        assert r.q_symbols == len(re.findall(r"[#*$%&|<>]", t or "")) and r.q_dup_lines == len(lines) - len(set(lines))
        assert r.q_base_failed == (len(w) < 20 or 100 * len(hit) > 30 * len(w))
    assert quality_rules.judge(table.limit(0)).count() == 0
    with pytest.raises(ValueError):
        quality_rules.judge(table.withColumn("q_words", F.lit(1)))


def brute_components(texts: dict):
    sets = {}
    for k, t in texts.items():
        w = WORD.findall(lower(t))
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(sets)
    for a in keys:
        for b in keys:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: (len(sets[k]), find(k)) for k in keys}


def test_jaccard_components(spark, monkeypatch):
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    shared = [r.choice(vocabulary) for _ in range(60)]
    texts = list(ODD)
    for _ in range(12):
        base = [r.choice(vocabulary) for _ in range(r.choice([4, 5, 9, 40, 150, 400]))]
        texts.append(" ".join(base))
        for _ in range(r.randint(1, 12)):  # copies that drift over the threshold
            copy = list(texts[-1].split())
            for _ in range(max(1, len(copy) // r.choice([40, 60, 90]))):
                copy[r.randrange(len(copy))] = r.choice(vocabulary)
            if r.random() < 0.3:
                copy += shared
            texts.append(" ".join(copy).upper() if r.random() < 0.2 else " ".join(copy))
    texts += [" ".join(shared + [r.choice(vocabulary) for _ in range(100)]) for _ in range(20)]
    monkeypatch.setattr(jaccard_join, "BLOCK", 4)  # blocks, second rounds and spread partners on a small table
    monkeypatch.setattr(jaccard_join, "FEW", 6)
    monkeypatch.setattr(jaccard_join, "OPEN_BLOCK", 4)
    table = dict(enumerate(texts))
    docs = spark.createDataFrame(list(table.items()), "doc_id long, text string").repartition(4)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard_join.jaccard_components(docs).collect()}
    assert got == brute_components(table)


@pytest.mark.parametrize("many", [1, 10**9])
@pytest.mark.parametrize("left", [None, 25])
def test_tree_links_join_what_all_pairs_join(monkeypatch, many, left):
    monkeypatch.setattr(jaccard_join, "MANY", many)
    r = np.random.default_rng(7)
    base = np.sort(r.choice(2**50, 60, replace=False))
    sets = [base[:50].astype(np.uint64)]
    for _ in range(59):
        x = base[: r.integers(40, 61)].copy()
        x[r.choice(len(x), int(r.integers(0, 8)), replace=False)] = r.integers(0, 2**50)
        sets.append(np.unique(x).astype(np.uint64))
    own = r.integers(0, 30, len(sets)).tolist()

    def parts(links):
        root = list(range(len(sets)))
        for a, b in [*links, *((i, own.index(c)) for i, c in enumerate(own))]:
            x, y = sorted((root[a], root[b]))
            root = [x if c == y else c for c in root]
        return root

    crosses = lambda i, j: left is None or (i < left) != (j < left)
    want = [
        (i, j) for i in range(len(sets)) for j in range(i)
        if crosses(i, j) and jaccard_join.linked(len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j]))
    ]
    links, _ = jaccard_join.tree_links(sets, own, left)
    assert {(max(x), min(x)) for x in links} <= set(want)
    assert parts(links) == parts(want)


def test_jaccard_of_nothing(spark):
    docs = spark.createDataFrame([(None, None), (3, ""), (None, "a b c d e f")], "doc_id long, text string")
    assert sorted((r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs).collect() if r.doc_id or r.n_shingles) == [(0, 3), (2, None)]
    assert jaccard_join.jaccard_components(docs.limit(0)).count() == 0


def test_warc_round_trip(spark, tmp_path):
    long = "<html>" + "é" * 80
    rows = [(5, "u\r\nX: y", long), (3, None, long), (9, "u", long), (1, "u", "short"), (2, "u", "short"), (4, "u", None), (None, "u", long), (3, "u", long)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write_warc(pages, str(tmp_path / "w"), shard_bytes=300, file_bytes=400)
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_warc(spark, str(tmp_path / "w")).collect()), key=str)
    want = []
    for i, _, html in rows:
        data = (html or "").encode()
        again = len(data) >= 100 and i != 3
        want.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", 3 if again else None))
    assert got == sorted(want, key=str)
    warc.write_warc(pages.repartition(5), str(tmp_path / "v"), shard_bytes=300, file_bytes=400)
    read = lambda p: sorted((f.name, f.read_bytes()) for f in (tmp_path / p).glob("*.warc.gz"))
    assert read("w") == read("v") and len(read("w")) > 1  # the same files whatever the order of the rows
    warc.write_warc(pages.limit(0), str(tmp_path / "e"))
    assert warc.read_warc(spark, str(tmp_path / "e")).count() == 0


def test_overlaps_survive_changed_words(spark):
    r = random.Random(2)
    vocabulary = [f"v{i}" for i in range(500)]
    item = [r.choice(vocabulary) for _ in range(40)]
    noise = lambda n: [r.choice(vocabulary) for _ in range(n)]
    texts = []
    for every in (0, 5, 6, 7, 8):
        copy = [("zz" if every and i % every == every - 1 else w) for i, w in enumerate(item)]
        texts.append(" ".join(noise(30) + copy + noise(30)).upper())
    texts += [" ".join(noise(200)), " ".join(noise(20) + item[:12] + noise(20)), " ".join(item[5:20]), "a b c", *ODD]
    bench = spark.createDataFrame([(7, " ".join(item)), (8, None), (9, ""), (None, "x"), (10, "a b c")], "item_id long, text string")
    got = {x.doc_id: x.overlaps for x in spaced_seeds.mark_overlaps(docs_of(spark, texts).filter("score <> 'again'"), bench).collect()}
    for i in range(5):
        (hit,) = got[i]
        assert hit.item_id == 7 and hit.matched >= 32 and 30 <= hit.first_word < 35 and hit.end_word <= 70
    assert got[5] == [] and got[6] == [] and [h.item_id for h in got[7]] == [7]
    assert all(got[i] == [] for i in range(8, 9 + len(ODD)))  # an item of three words is not searched for
    every = spaced_seeds.mark_overlaps(docs_of(spark, texts[8:9]).filter("score <> 'again'"), bench, min_words=1)
    assert [h.item_id for h in every.first().overlaps] == [10]


def test_overlaps_with_changes_at_every_place():
    """Every overlap of the rule is found, against all runs of all diagonals, whatever words are changed."""
    share = Fraction(4, 5)
    for n in range(1, 21):
        item = [f"w{i}" for i in range(n)]
        bench = spaced_seeds.Benchmark([7], [" ".join(item)], share, 13)
        least = min(13, -(-4 * n // 5))
        assert bench.least == [least]
        texts, want = [], []
        for k in range(5 if n < 16 else 4):
            for places in itertools.combinations(range(n), k):
                equal = [i not in places for i in range(n)]
                runs = [sum(equal[a:b]) for a in range(n) for b in range(a + 1, n + 1) if 5 * sum(equal[a:b]) >= 4 * (b - a)]
                texts.append(" ".join(["x", *(w if same else "other" for w, same in zip(item, equal)), "y"]))
                want.append(max(runs, default=0))
        found = wordhash.words_of(pa.array(texts, pa.string()))
        hits = spaced_seeds._verify(bench, found.hashes, found.firsts)
        assert [hits[i][0]["matched"] if i in hits else 0 for i in range(len(texts))] == [m if m >= least else 0 for m in want]


def test_seeds_are_complete():
    def holds(mask: str, changed: tuple[int, ...], n: int) -> bool:
        ones = [i for i, c in enumerate(mask) if c == "1"]
        return any(not any(o + i in changed for i in ones) for o in range(n - len(mask) + 1))

    for least, n, k in ((8, 8, 0), (8, 9, 1), (8, 10, 2), (8, 15, 3), (4, 4, 0), (4, 5, 1)):
        for changed in itertools.combinations(range(n), k):
            assert any(holds(m, changed, n) for m in spaced_seeds.MASKS[least]), (least, n, changed)


def test_model_is_normalised_and_scores_add_up(spark):
    r = random.Random(4)
    texts = [" ".join(r.choice(["the", "of", "Cat", "dog", f"r{r.randint(0, 99)}"]) for _ in range(r.randint(0, 40))) for _ in range(120)] + [None, "", "new words"]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("held", bytecnn.held_out("doc_id", 5, 1))
    model = lbl.learn(table.filter("not held"))
    assert np.allclose((10.0**model.table).sum(1), 1)
    got = {x.doc_id: x for x in lbl.score(table, model, "doc_id", "text", "held").collect()}
    train = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 5 != 1]
    count = Counter(w for i in train for w in [*WORD.findall(lower(texts[i])), "\n"])
    n, v = sum(count.values()), len(count)
    for i, t in enumerate(texts):
        tokens_of = [*WORD.findall(lower(t)), "\n"]
        base = sum(np.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens_of)
        assert got[i].base_score == pytest.approx(base) and got[i].train_tokens == n and np.isfinite(got[i].score)
        assert (got[i].n_tokens, got[i].n_known) == (len(tokens_of), sum(count[w] > 0 for w in tokens_of))
        assert got[i].held_out == (i not in train)


def test_scores_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lbl, "LEAST", 3)
    r = random.Random(8)
    names = [f"w{chr(97 + k % 7)}{k}{chr(97 + k % 5)}" for k in range(150)]
    texts = [" ".join(names[min(int(r.expovariate(0.03)), 149)] for _ in range(r.randint(0, 60))) for _ in range(150)] + [None, "unseen q"]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("held", bytecnn.held_out("doc_id", 5, 1))
    model = lbl.learn(table.filter("not held"))
    units, w = model.units, model.vectors.astype(float)
    targets = len(units.shares)
    assert targets > lbl.TAILS and np.allclose(np.add.reduceat(units.shares, units.bounds[:-1]), 1)
    train = [t for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 5 != 1]
    count = Counter(x for t in train for x in WORD.findall(lower(t)))
    known = wordhash.words_of(pa.array([" ".join(count)]))
    keys = dict(zip(count, known.hashes.view(np.int64).tolist()))
    place = {k: j for j, k in enumerate(model.frequent.keys.tolist())}
    heads = {x for x in count if model.frequent.classes[place[keys[x]]] >= 0}
    group = lambda x: ord(x[-1]) & 31
    unit = lambda x: units.of_word[place[keys[x]]] if x in keys and units.of_word[place[keys[x]]] >= 0 else units.bounds[group(x) + 1] - 1
    cls = lambda x: model.frequent.classes[place[keys[x]]] if x in heads else lbl.HEAD + group(x)
    got = {x.doc_id: x.score for x in lbl.score(table, model, "doc_id", "text", "held").collect()}
    for i, t in enumerate(texts):
        words, total, one, two, before = WORD.findall(lower(t)), 0.0, lbl.END, lbl.END, units.end
        for x in words:
            total += model.table[two * lbl.CLASSES + one, cls(x)]
            if x not in heads:
                g = group(x)
                logits = w[targets + before, :-1] @ w[units.bounds[g] : units.bounds[g + 1], :-1].T + w[units.bounds[g] : units.bounds[g + 1], -1]
                p = np.exp(logits) / np.exp(logits).sum()
                total += np.log10(p[unit(x) - units.bounds[g]])
                if unit(x) == units.bounds[g + 1] - 1:
                    others = [c for y, c in count.items() if y not in heads and group(y) == g and unit(y) == unit(x)]
                    total += np.log10((count[x] + 0.5) / (sum(others) + 0.5 * (len(others) + 1)))
            two, one, before = one, cls(x), unit(x)
        total += model.table[two * lbl.CLASSES + one, lbl.END]
        assert got[i] == pytest.approx(total, rel=1e-4)


def test_vectors_learn_what_follows(spark, monkeypatch):
    """Words that always follow one another inside a group are told apart; nothing is learnt from no pairs."""
    monkeypatch.setattr(lbl, "LEAST", 3)
    pairs = [(f"a{k}x", f"b{k}x") for k in range(90)]
    texts = [" ".join(f"{a} {b}" for a, b in random.Random(i).sample(pairs, 40)) for i in range(200)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    total = lambda m: sum(x.score for x in lbl.score(table.withColumn("held", F.lit(False)), m, "doc_id", "text", "held").collect())
    learnt = total(lbl.learn(table))
    monkeypatch.setattr(lbl, "ROUNDS", 0)
    assert learnt > total(lbl.learn(table))
    empty = lbl.learn(table.limit(0))
    assert all(np.isfinite(x.score) for x in lbl.score(table.limit(3).withColumn("held", F.lit(False)), empty, "doc_id", "text", "held").collect())


def test_rare_words_are_joined(spark, monkeypatch):
    table = spark.createDataFrame([(i, "a b c d e f g h " * (i % 3 + 1)) for i in range(20)], "doc_id long, text string").withColumn("held", F.lit(False))
    whole = {r.doc_id: r.score for r in lbl.score(table, lbl.learn(table), "doc_id", "text", "held").collect()}
    monkeypatch.setattr(lbl, "HEAD", 2)
    monkeypatch.setattr(lbl, "END", 2 + lbl.TAILS)
    monkeypatch.setattr(lbl, "CLASSES", 3 + lbl.TAILS)
    monkeypatch.setattr(lbl, "FREQUENT", 3)
    model = lbl.learn(table)
    got = lbl.score(table, model, "doc_id", "text", "held").collect()
    assert all(r.n_known == r.n_tokens and r.score > -200 for r in got) and len(got) == len(whole)


def test_classifier_learns(spark):
    r = random.Random(6)
    good = lambda: " ".join(r.choice(["the", "river", "and", "stone", "under", "light"]) for _ in range(60))
    rows = [(i, good() if i % 3 else good().upper().replace(" ", "!! "), int(i % 3 > 0)) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    net = bytecnn.train(docs.filter("doc_id < 100").select("doc_id", "text"), docs.select("doc_id", "quality"))
    got = bytecnn.score(docs, net).filter("doc_id >= 100").collect()
    assert np.mean([(x.score >= 0.5) == bool(x.quality) for x in got]) > 0.95
    odd = bytecnn.score(docs_of(spark, ODD), net, name="p").collect()
    assert all(0 <= x.p <= 1 for x in odd) and len(odd) == len(ODD) + 2


def test_classifier_sample_is_not_used_up(spark, monkeypatch):
    """Labels without a document and a text above the bound take no other row's place."""
    seen = []
    monkeypatch.setattr(bytecnn, "fit", lambda texts, labels: seen.append(len(texts)) or bytecnn.Network.fresh(len(texts)))
    docs = spark.createDataFrame([(i, "y" * 5000 if i % 4 == 0 else "x" * 10) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, quality int")
    fresh = lambda n: bytecnn.Network.fresh(n).filters
    assert np.array_equal(bytecnn.train(docs, labels, rows=40, most_bytes=4000).filters, fresh(30))
    assert np.array_equal(bytecnn.train(docs, labels, rows=25, most_bytes=1 << 20).filters, fresh(25))
    assert np.array_equal(bytecnn.train(docs.filter("doc_id < 0"), labels).filters, fresh(7))
    assert bytecnn.fitting(np.array([1000, 10, 10, 1200, 10]), 1100).tolist() == [True, True, True, False, True]


def test_shards_fit(spark):
    r = random.Random(8)
    rows = [(i, r.randint(0, 90)) for i in range(500)] + [(77, 60)] * 200 + [(None, 10), (3, None), (4, 5000)]
    table = spark.createDataFrame(rows, "doc_id long, size long").repartition(4)
    got = sharding.assign_shards(table, "doc_id", F.col("size"), 1000).collect()
    assert len(got) == len(rows)
    size, prefixes = Counter(), set()
    for x in got:
        size[x.shard] += x.shard_row_bytes
        if x.shard_depth < 60:
            bits = bin(int(hashlib.md5(str("" if x.doc_id is None else x.doc_id).encode()).hexdigest()[:15], 16))[2:].zfill(60)
            assert bits.startswith(x.shard) and len(x.shard) == x.shard_depth
            prefixes.add(x.shard)
    assert all(n <= 1000 or "!" in s for s, n in size.items())
    assert not any(a != b and b.startswith(a) for a in prefixes for b in prefixes)
    # Only a bucket beyond the limit was split.
    sums = Counter()
    for x in got:
        if x.shard_row_bytes <= 1000:
            bits = bin(int(hashlib.md5(str("" if x.doc_id is None else x.doc_id).encode()).hexdigest()[:15], 16))[2:].zfill(60)
            for d in range(61):
                sums[bits[:d]] += x.shard_row_bytes
    assert all(sums[p[:-1]] > 1000 for p in prefixes if p)


def test_quotes_are_linked(spark):
    rows = [
        (1, 0, "user", "Where does the train to the coast leave?\nI have two bags."),
        (1, 1, "assistant", "It leaves from platform nine at noon."),
        (1, 2, "user", "Ann wrote:\n> Where does the train to the\n> coast leave? I have two bags.\nI know that too."),
        (1, 3, "user", "Bob wrote:\n> Ann wrote:\n>> Where does the train to the\n>> coast leave? I have two bags.\n> I know that too.\nFine."),
        (1, 4, "user", "> nobody ever said this\nok"),
        (1, 5, "user", None), (None, 0, "user", "> x"), (2, None, "user", "a"), (2, 1, "user", "Where does the train to the coast leave?"),
    ]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): r for r in quotes.format_chats(table).collect()}
    assert len(got) == len(rows)
    assert [(got[1, t].reply_to, got[1, t].root, got[1, t].depth) for t in range(6)] == [
        (None, 0, 0), (None, 1, 0), (0, 0, 1), (2, 0, 2), (None, 4, 0), (None, 5, 0)
    ]
    assert [got[1, t].text for t in range(1, 6)] == ["It leaves from platform nine at noon.", "I know that too.", "Fine.", "ok", ""]
    assert got[2, 1].reply_to is None
    assert quotes.format_chats(table.limit(0)).count() == 0


def test_short_lines_and_wrapped_paragraphs_are_linked(spark):
    letter = "The first part is about\nthe boat.\n\nThe second part is about\nthe long road.\n\nThe third part is about the hill."
    rows = [
        (1, 0, "user", "Monday\nTuesday works"), (1, 1, "assistant", "Neither"), (1, 2, "user", "> Monday\nToo soon."),
        (2, 0, "user", letter), (2, 1, "assistant", "Well."),
        (2, 2, "user", "> The first part\n> is about the boat.\n>\n> The second part is\n> about the long road.\nYes."),
        (3, 0, "user", letter.replace("\n", "\r\n")), (3, 1, "assistant", "Well."),
        (3, 2, "user", "> The second part is\r\n> about the long road.\r\n> \r\n> The third part\r\n> is about the hill.\r\nNo."),
        (4, 0, "user", "我明天去北京\n你呢"), (4, 1, "assistant", "好"), (4, 2, "user", "> 我明天去北京\n太好了"),
    ]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): (r.reply_to, r.root, r.depth) for r in quotes.format_chats(table).collect()}
    assert [got[c, 2] for c in (1, 2, 3, 4)] == [(0, 0, 1)] * 4
    assert all(got[c, t] == (None, t, 0) for c in (1, 2, 3, 4) for t in (0, 1))
