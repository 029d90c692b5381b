from __future__ import annotations

import random
import re
import time
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from twinline.functions.sequences import UNK
from twinline.functions.text import fold
from twinline.operators import encoding, merging, subword
from twinline.operators.subword import PROTECTED, WORD_MARK, SubwordModel, learn_bpe

PAIR = "ord long, src string, tgt string"


def join(syms, left, right):
    out, i = [], 0
    while i < len(syms):
        if syms[i : i + 2] == [left, right]:
            out.append(left + right)
            i += 2
        else:
            out.append(syms[i])
            i += 1
    return out


def brute_learn(words: dict[str, int], kept: set[str], vocab_size: int, seeds: int):
    """One merge a round, recounting everything."""
    state = {w: [c if c in kept or c in PROTECTED else None for c in WORD_MARK + w] for w in words}
    pieces, merges = set(kept) | set(PROTECTED), []
    n = seeds
    while n < vocab_size:
        counts = Counter()
        for w, syms in state.items():
            for pair in zip(syms, syms[1:]):
                if None not in pair and not set(pair) & set(PROTECTED):
                    counts[pair] += words[w]
        if not counts:
            break
        (left, right), freq = min(counts.items(), key=lambda kv: (-kv[1], kv[0]))
        merges.append((len(merges), left, right, freq))
        state = {w: join(s, left, right) for w, s in state.items()}
        n += left + right not in pieces
        pieces.add(left + right)
    return merges, state


def random_words(seed, alphabet="abc7", n=60):
    rng = random.Random(seed)
    return {"".join(rng.choices(alphabet, k=rng.randint(1, 9))): rng.randint(1, 20) for _ in range(n)}


@pytest.mark.parametrize("seed, alphabet, size", [(1, "abc7", 60), (2, "ab", 40), (3, "abcdefgh", 120)])
def test_learning_equals_one_merge_a_round(spark, seed, alphabet, size):
    words = random_words(seed, alphabet)
    df = spark.createDataFrame(list(words.items()), "word string, freq long")
    kept = {r.char for r in subword.char_coverage(df).filter("kept").collect()}
    seeds = 4 + len(PROTECTED) + len(kept - set(PROTECTED))
    merges, state = brute_learn(words, kept, size, seeds)
    model = learn_bpe(df, size, guess_words=9, rebase_every=5)
    assert model.merges == merges
    assert len(model.vocab) <= size and [i for i, _, _ in model.vocab] == list(range(len(model.vocab)))
    # Encoding replays the learner: each word ends in the same pieces.
    ids = {p: i for i, p, k in model.vocab if k != "special"}
    encode = encoding._word_encoder(model)
    for word, syms in state.items():
        assert encode(word) == [ids[s] for s in syms if s is not None] or None in syms


def test_rounds_settle_many_merges(spark):
    words = random_words(4, "abcdefghijklmnop", 300)
    df = spark.createDataFrame(list(words.items()), "word string, freq long")
    told = []
    model = learn_bpe(df, 90, on_round=lambda *x: told.append(x))
    assert told[-1] == (model.rounds, len(model.merges)) and model.rounds < len(model.merges) / 2


@pytest.mark.parametrize("limits", [{"most_pairs": 7}, {"rebase_every": 3, "guess_words": 0}, {"most_pairs": 20, "guess_words": 5}])
def test_limits_change_no_merge(spark, limits):
    """Few held pairs, frequent storing and poor guesses cost rounds and nothing else."""
    words = random_words(6, "abcd7", 80)
    df = spark.createDataFrame(list(words.items()), "word string, freq long")
    kept = {r.char for r in subword.char_coverage(df).filter("kept").collect()}
    merges, _ = brute_learn(words, kept, 70, 4 + len(PROTECTED) + len(kept - set(PROTECTED)))
    assert learn_bpe(df, 70, **limits).merges == merges


def test_learning_ends_when_no_pair_is_left(spark):
    df = spark.createDataFrame([("ab", 2), ("7", 1), ("", 3)], "word string, freq long")
    assert [m[1:] for m in learn_bpe(df, 500).merges] == [("a", "b", 2), (WORD_MARK, "ab", 2)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=14), st.integers(0, 3), st.integers(0, 3))
def test_local_changes_equal_a_recount(ids, left, right):
    at = merging.occurrences(ids, left, right)
    after = merging.merged(ids, at, 9)
    assert after == join_ids(ids, left, right)
    want = Counter(zip(after, after[1:]))
    want.subtract(Counter(zip(ids, ids[1:])))
    got = Counter()
    for a, b, n in merging.changes(ids, at, 9):
        got[a, b] += n
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}


def join_ids(ids, left, right):
    out, i = [], 0
    while i < len(ids):
        hit = ids[i : i + 2] == [left, right]
        out.append(9 if hit else ids[i])
        i += 1 + hit
    return out


def replayed(model, word):
    """All merges one after another."""
    ids = {p: i for i, p, k in model.vocab if k != "special"}
    syms = [c if c in ids else None for c in WORD_MARK + word]
    for _, left, right, _ in model.merges:
        syms = join(syms, left, right)
    found = [UNK if s is None else ids[s] for s in syms]
    return [x for i, x in enumerate(found) if x != UNK or i == 0 or found[i - 1] != UNK]


def test_encoding_equals_replaying_the_merges(spark):
    words = random_words(8, "abcé7", 200)
    df = spark.createDataFrame(list(words.items()), "word string, freq long")
    model = learn_bpe(df, 150, coverage=0.99)
    encode, rng = encoding._word_encoder(model), random.Random(3)
    for _ in range(300):
        word = "".join(rng.choices("aabbcé7x", k=rng.randint(1, 30)))
        assert encode(word) == replayed(model, word)
    texts = [" ".join(rng.choices(list(words), k=rng.randint(0, 5))) for _ in range(50)] + [None, "", " \n ", "a\tb  c ", "ABC a\xa0b"]
    pairs = spark.createDataFrame([(i, t, texts[-1 - i]) for i, t in enumerate(texts)], PAIR)
    for r in encoding.encode_pairs(pairs, model).collect():
        for text, ids in ((r.src, r.src_ids), (r.tgt, r.tgt_ids)):
            want = None if text is None else [i for w in re.split(subword.RAW_SPLIT, text) for v in fold(w).split(" ") if v for i in replayed(model, v)]
            assert ids == want


def test_long_words_are_encoded_fast(spark, learned):
    encode = encoding._word_encoder(learned)
    word = "".join(random.Random(1).choices("thehousein", k=16_000))
    start = time.perf_counter()
    assert len(encode(word)) > 1000
    assert time.perf_counter() - start < 1


CORPUS = [
    (1, "Ana m3ak fil dar", "I am with you in the house"),
    (2, "enti m3aha   fil dar", "you are with her in the house"),
    (3, "a3tini 7aja o5ra", "give me the other thing"),
    (4, "", "the house"),
]


@pytest.fixture(scope="module")
def learned(spark):
    pairs = spark.createDataFrame(CORPUS, PAIR)
    return learn_bpe(subword.word_freq(pairs), 60, coverage=1.0)


def test_round_trip_and_protected_symbols(spark, learned):
    pairs = spark.createDataFrame(CORPUS, PAIR)
    vocab = learned.vocab_frame(spark)
    encoded = encoding.encode_pairs(pairs, learned)
    decoded = encoding.decode_text(encoded, vocab, "src_ids").orderBy("ord").collect()
    assert [r.decoded for r in decoded] == ["ana m3ak fil dar", "enti m3aha fil dar", "a3tini 7aja o5ra", ""]
    kinds = {p: (i, k) for i, p, k in learned.vocab}
    assert all(kinds[d][0] > 3 and kinds[d][1] == "protected" for d in PROTECTED)
    assert not any(d in left + right for d in PROTECTED for _, left, right, _ in learned.merges)
    assert {(r.side, r.n_unk) for r in encoding.unk_rate(encoded).collect()} == {("src", 0), ("tgt", 0)}
    report = subword.vocab_report(learned, subword.word_freq(pairs)).first()
    assert (report.n_pieces, report.n_protected) == (len(learned.vocab), 4)


def test_unknown_runs_and_special_ids(spark, learned):
    pairs = spark.createDataFrame([(1, "中文a 中", None)], PAIR)
    encoded = encoding.encode_pairs(pairs, learned)
    row = encoded.first()
    assert row.src_ids.count(UNK) == 2 and row.tgt_ids is None
    vocab = learned.vocab_frame(spark)
    framed = encoded.withColumn("ids", F.concat(F.array(F.lit(2)), "src_ids", F.array(F.lit(3), F.lit(0))))
    assert encoding.decode_text(framed, vocab, "ids").first().decoded == " ⁇ a  ⁇ "


def test_variants_share_pieces(spark, learned):
    pairs = spark.createDataFrame([(1, "m3ak", "m3aha")], PAIR)
    shared = encoding.shared_pieces(encoding.encode_pairs(pairs, learned), learned.vocab_frame(spark)).first()
    assert "3" in shared.shared and shared.shared_ids == sorted(shared.shared_ids)


def test_model_is_saved_and_loaded(spark, learned, tmp_path):
    learned.save(spark, str(tmp_path / "model"))
    again = SubwordModel.load(spark, str(tmp_path / "model"))
    assert (again.merges, again.vocab) == (learned.merges, learned.vocab)


def test_vocabulary_too_small(spark):
    df = spark.createDataFrame([("abc", 1)], "word string, freq long")
    with pytest.raises(ValueError):
        learn_bpe(df, 10)


def test_coverage_cut(spark):
    df = spark.createDataFrame([("a", 90), ("b", 9), ("c", 1)], "word string, freq long")
    got = {r.char: r.kept for r in subword.char_coverage(df, 0.95).collect()}
    assert got == {WORD_MARK: True, "a": True, "b": False, "c": False}


@pytest.mark.parametrize("seed", range(30))
def test_shards_follow_the_rule_of_one_word(seed):
    """All places of a merge at once, merges taken back, and words read out, against words one by one."""
    rng = random.Random(seed)
    words = [[rng.randint(-1, 4) for _ in range(rng.randint(0, 14))] for _ in range(rng.randint(0, 12))]
    freq = [rng.randint(1, 9) for _ in words]
    shard = merging.Shard(merging.pa.array(words, merging.pa.list_(merging.pa.int32())), merging.pa.array(freq, merging.pa.int64()), frozenset([3]), True)
    known, states = [0, 1, 2, 4], [words]
    for new in range(10, 16):
        left, right = rng.choice(known), rng.choice(known)
        want, after = Counter(), []
        for w, f in zip(states[-1], freq):
            at = merging.occurrences(w, left, right)
            after.append(merging.merged(w, at, new))
            for a, b, n in merging.changes(w, at, new):
                if not {a, b} & {-1, 3}:
                    want[a, b] += n * f
        a, b, n = shard.apply((left, right, new))
        assert dict(zip(zip(a.tolist(), b.tolist()), n.tolist())) == {p: n for p, n in want.items() if n}
        states.append(after)
        known.append(new)
    for count in (6, rng.randint(0, 6), 0):
        shard.back_to(min(count, len(shard.applied)))
        ids, f = shard.words()
        kept = [(w, x) for w, x in zip(states[len(shard.applied)], freq) if len(w) > 1]
        assert list(zip(ids.to_pylist(), f.to_pylist())) == kept


def test_many_merges_of_many_words_are_fast():
    rng = random.Random(2)
    size = [rng.randint(6, 14) for _ in range(200_000)]
    ids = merging.pa.array([rng.choices(range(20), k=k) for k in size], merging.pa.list_(merging.pa.int32()))
    shard = merging.Shard(ids, merging.pa.array([1] * len(size), merging.pa.int64()), frozenset())
    start = time.perf_counter()
    for k in range(300):
        shard.apply((k % 20, k // 20, 20 + k))
    assert time.perf_counter() - start < 3


def test_near_ties_in_another_order_settle_in_one_round(spark):
    """Guesses with poor counts come in another order than the merges; those that share no place pass each other."""
    words = random_words(9, "abcdefghijklmnopqrstuvwxyz", 400)
    df = spark.createDataFrame(list(words.items()), "word string, freq long")
    poor, exact = learn_bpe(df, 200, guess_words=200), learn_bpe(df, 200)
    assert poor.merges == exact.merges and len(poor.merges) > 100 and poor.rounds <= 20
