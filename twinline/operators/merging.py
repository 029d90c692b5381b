"""Merge learning where the words lie.

Distinct words lie in stored shards. Each round is one job: the driver guesses the next merges, every shard applies them one
by one, each at all its places at once, and reports what each changed. With these exact changes the driver puts its guesses in
the right order and stops at the first most frequent pair that is none of them, or whose changes do not follow from the
reports. So guesses decide how many merges a round settles, and never which.

The guesses come from the exact counts of all pairs and, for what the guessed merges change, from the most frequent words.

Tasks keep nothing between rounds: a shard is read from its stored rows and brought up to date, so lost executors and repeated
tasks change nothing, and it does not matter which worker gets which shard.
"""

from __future__ import annotations

import heapq
import json
from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinline.session import discard, store

SHARD_SCHEMA = "ids array<int>, freq long"
REPORT_SCHEMA = "step int, a int, b int, n long"
NEVER = -1  # a symbol that never pairs
GONE = -2  # a place that a merge has emptied
GUESS_WORDS = 500_000  # of the most frequent words, which the driver guesses with
LEAST_GUESSES, MOST_GUESSES = 128, 512  # merges a round
MOST_PAIRS = 1_000_000  # held by the driver; rarer pairs are fetched when these are used up
REBASE_EVERY = 1_000  # merges after which the shards, which every round reads, are stored anew

Merge = tuple[int, int, int]


def occurrences(ids: list[int], left: int, right: int) -> list[int]:
    """Where the pair begins, from left to right without overlap: the rule for one word, which shards follow for all."""
    found, at, last = [], 0, len(ids) - 1
    while True:
        try:
            at = ids.index(left, at, last)
        except ValueError:
            return found
        if ids[at + 1] == right:
            found.append(at)
            at += 2
        else:
            at += 1


def changes(ids: list[int], at: list[int], new: int) -> Iterator[tuple[int, int, int]]:
    """Pairs that go and come, as ``(left, right, -1 or 1)``, when the pairs at ``at`` become ``new``."""
    size, before = len(ids), -9
    for n, k in enumerate(at):
        follows = before == k - 2  # right behind another one: what lies between was counted there
        if k and not follows:
            yield ids[k - 1], ids[k], -1
            yield ids[k - 1], new, 1
        yield ids[k], ids[k + 1], -1
        if k + 2 < size:
            yield ids[k + 1], ids[k + 2], -1
            next_too = n + 1 < len(at) and at[n + 1] == k + 2
            yield new, new if next_too else ids[k + 2], 1
        before = k


def merged(ids: list[int], at: list[int], new: int) -> list[int]:
    out, done = [], 0
    for k in at:
        out += ids[done:k]
        out.append(new)
        done = k + 2
    return out + ids[done:]


class Shard:
    """Words in one run of places, each with its symbol and neighbours, and the places where each symbol has stood.

    A merge looks at the places of the rarer of its two symbols, all at once, and the run never moves: what a merge costs
    follows these places, and not the words. ``undoable`` shards take merges back.
    """

    def __init__(self, ids: pa.Array, freq: pa.Array, fixed: frozenset[int], undoable: bool = False):
        self.undoable = undoable
        size = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        # A symbol that never pairs stands before each word and after the last one.
        total = int(size.sum()) + len(size) + 1
        begin = np.cumsum(size + 1) - size
        self.begin = np.append(begin - 1, total - 1)
        filled = np.ones(total, bool)
        filled[self.begin] = False
        self.symbols = np.full(total, NEVER, np.int32)
        self.symbols[filled] = ids.flatten().to_numpy(zero_copy_only=False)
        self.freq = np.zeros(total, np.int64)
        self.freq[filled] = np.repeat(freq.to_numpy(zero_copy_only=False), size)
        self.after, self.before = np.arange(1, total + 1), np.arange(-1, total - 1)
        self.bars = np.array(sorted(fixed | {NEVER}), np.int32)
        order = np.argsort(self.symbols, kind="stable")
        found, first = np.unique(self.symbols[order], return_index=True)
        self.places = dict(zip(found.tolist(), np.split(order, first[1:])))
        self.places.pop(NEVER, None)
        self.applied: list[Merge] = []
        self.undo: list[tuple | None] = []

    def _standing(self, symbol: int) -> np.ndarray:
        """Where the symbol stands, from left to right."""
        places = self.places.get(symbol)
        if places is None:
            return np.zeros(0, np.int64)
        held = places[self.symbols[places] == symbol]
        if not self.undoable:
            self.places[symbol] = held
        return held

    def _pairs(self, left: int, right: int) -> np.ndarray:
        """Where the pair begins, from left to right without overlap."""
        if len(self.places.get(left, ())) <= len(self.places.get(right, ())):
            at = self._standing(left)
            at = at[self.symbols[self.after[at]] == right]
        else:
            at = self.before[self._standing(right)]
            at = at[self.symbols[at] == left]
        if left == right and len(at):  # of each run every other one
            starts = np.ones(len(at), bool)
            starts[1:] = self.after[at[:-1]] != at[1:]
            number = np.arange(len(at))
            at = at[(number - np.maximum.accumulate(np.where(starts, number, 0))) % 2 == 0]
        return at

    def apply(self, merge: Merge, counted: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """Merge the pair in all words; gives what it changed in the counts of pairs, as ``left, right, change``."""
        left, right, new = merge
        at = self._pairs(left, right)
        second = self.after[at]
        later = self.after[second]
        changed = self._changed(merge, at, second, later) if counted else None
        self.symbols[at], self.symbols[second] = new, GONE
        self.after[at], self.before[later] = later, at
        had = self.places.get(new)
        if len(at):
            self.places[new] = at if had is None else np.union1d(had, at)
        self.applied.append(merge)
        self.undo.append((at, second, later, had) if self.undoable else None)
        return changed

    def _changed(
        self, merge: Merge, at: np.ndarray, second: np.ndarray, later: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """:func:`changes` of all places, summed by pair."""
        left, right, new = merge
        prior, freq = self.before[at], self.freq[at]
        # Right behind another one: what lies between is counted there.
        alone = np.ones(len(at), bool)
        alone[1:] = prior[1:] != second[:-1]
        touching = np.zeros(len(at), bool)
        touching[:-1] = ~alone[1:]
        ahead, behind = self.symbols[prior[alone]], self.symbols[later]
        one = lambda n, symbol: np.full(n, symbol, np.int32)
        k, n = len(ahead), len(at)
        a = np.concatenate([ahead, ahead, one(n, left), one(n, right), one(n, new)])
        b = np.concatenate([one(k, left), one(k, new), one(n, right), behind, np.where(touching, new, behind)])
        change = np.concatenate([-freq[alone], freq[alone], -freq, -freq, freq])
        may = ~(np.isin(a, self.bars) | np.isin(b, self.bars))
        key = (a[may].astype(np.int64) << 32) | b[may]
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        sums = np.add.reduceat(change[may][order], first) if len(first) else np.zeros(0, np.int64)
        key, sums = key[first][sums != 0], sums[sums != 0]
        return (key >> 32).astype(np.int32), (key & 0xFFFFFFFF).astype(np.int32), sums

    def back_to(self, count: int) -> None:
        """Take merges back until ``count`` remain; none of them may be settled."""
        while len(self.applied) > count:
            left, right, new = self.applied.pop()
            at, second, later, had = self.undo.pop()
            # From right to left: of merges that touch, the later place was the neighbour of the earlier.
            self.symbols[at], self.symbols[second] = left, right
            self.after[at], self.before[later] = second, second
            if had is None:
                self.places.pop(new, None)
            else:
                self.places[new] = had

    def settle(self, count: int) -> None:
        """The first ``count`` merges, which are all, will not be taken back."""
        touched = set()
        for k in range(count - 1, -1, -1):
            if self.undo[k] is None:
                break
            self.undo[k] = None
            touched.update(self.applied[k][:2])
        for symbol in touched & self.places.keys():
            self.places[symbol] = self.places[symbol][self.symbols[self.places[symbol]] == symbol]

    def words(self) -> tuple[pa.Array, pa.Array]:
        """``ids, freq`` of the words that are more than one symbol."""
        live = self.symbols != GONE
        size = np.add.reduceat(live.astype(np.int64), self.begin)[:-1] - 1  # the bar before a word is live too
        kept = size > 1
        word = np.repeat(np.arange(len(self.begin)), np.diff(self.begin, append=len(live)))
        live[self.begin] = False
        live &= np.append(kept, False)[word]
        offsets = np.concatenate([[0], np.cumsum(size[kept])]).astype(np.int32)
        freq = self.freq[self.begin[:-1][kept] + 1]
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(self.symbols[live])), pa.array(freq)


def _shard(batches: Iterator[pa.RecordBatch], fixed: frozenset[int], merges: Sequence[Merge]) -> Shard:
    """This task's words with ``merges`` applied."""
    rows = pa.Table.from_batches(batches, pa.schema([("ids", pa.list_(pa.int32())), ("freq", pa.int64())]))
    shard = Shard(rows["ids"].combine_chunks(), rows["freq"].combine_chunks(), fixed)
    for merge in merges:
        shard.apply(merge, counted=False)
    return shard


def report(shards: DataFrame, fixed: frozenset[int], merges: Sequence[Merge], settled: int) -> pa.Table:
    """What each merge beyond the first ``settled`` changes in the counts of pairs, over all shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _shard(batches, fixed, merges[:settled])
        for step in range(settled, len(merges)):
            a, b, n = shard.apply(merges[step])
            if len(n):
                columns = [pa.array(c) for c in (np.full(len(n), step, np.int32), a, b, n)]
                yield pa.RecordBatch.from_arrays(columns, names=["step", "a", "b", "n"])

    # A merge changes at most a few counts a symbol: bounded by the vocabulary, not by the words.
    return shards.mapInArrow(run, REPORT_SCHEMA).groupBy("step", "a", "b").agg(F.sum("n").alias("n")).toArrow()


def rebased(shards: DataFrame, fixed: frozenset[int], merges: Sequence[Merge]) -> DataFrame:
    """The words with all ``merges`` applied; those that have become one symbol are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.RecordBatch.from_arrays([*_shard(batches, fixed, merges).words()], names=["ids", "freq"])
        for at in range(0, rows.num_rows, 10_000):
            yield rows.slice(at, 10_000)

    return shards.mapInArrow(run, SHARD_SCHEMA)


def pair_totals(
    shards: DataFrame, fixed: frozenset[int], names: Sequence[str], most: int
) -> tuple[dict[tuple[int, int], int], tuple | None]:
    """The ``most`` first pairs in the order of merging, and the place after which pairs are missing (null: nowhere)."""
    pairs = shards.select(
        F.inline(F.arrays_zip(F.slice("ids", 1, F.size("ids") - 1).alias("a"), F.slice("ids", 2, F.size("ids") - 1).alias("b"))), "freq"
    ).filter("a >= 0 and b >= 0")
    if fixed:
        pairs = pairs.filter(~F.col("a").isin(*fixed) & ~F.col("b").isin(*fixed))
    listed = F.from_json(F.lit(json.dumps(list(names))), "array<string>")
    ranked = pairs.groupBy("a", "b").agg(F.sum("freq").alias("n")).orderBy(
        F.desc("n"), F.get(listed, F.col("a")), F.get(listed, F.col("b"))
    )
    counted = ranked.limit(most).toArrow()
    rows = list(zip(*(counted.column(c).to_pylist() for c in ("a", "b", "n"))))
    a, b, n = rows[-1] if len(rows) == most else (0, 0, 0)
    return {(a, b): n for a, b, n in rows}, (-n, names[a], names[b]) if n else None


@dataclass
class Learner:
    """The driver's side: pair counts, and a heap whose entries are corrected when they come up."""

    names: list[str]
    totals: dict[tuple[int, int], int]
    last: tuple | None  # pairs that come later in the order of merging are not held

    def __post_init__(self):
        self.ids = {s: i for i, s in enumerate(self.names)}
        self.fill()

    def fill(self) -> None:
        self.heap = [self._entry(p, n) for p, n in self.totals.items()]
        heapq.heapify(self.heap)

    def _entry(self, pair: tuple[int, int], n: int) -> tuple:
        return -n, self.names[pair[0]], self.names[pair[1]], pair

    def put(self, pair: tuple[int, int], total: int) -> None:
        if total > 0:
            if total > self.totals.get(pair, 0):  # a lower count is corrected when the old entry comes up
                heapq.heappush(self.heap, self._entry(pair, total))
            self.totals[pair] = total
        else:
            self.totals.pop(pair, None)
        if len(self.heap) > 4 * len(self.totals) + 100_000:
            self.fill()

    def add(self, pair: tuple[int, int], n: int) -> None:
        self.put(pair, self.totals.get(pair, 0) + n)

    def top(self) -> tuple[int, int] | None:
        """The most frequent pair; ties go to the smaller left, then right symbol. None if that pair is not held."""
        while self.heap:
            pair = self.heap[0][3]
            total = self.totals.get(pair, 0)
            if total == -self.heap[0][0]:
                return None if self.last and self.heap[0][:3] > self.last else pair
            if total > 0:
                heapq.heapreplace(self.heap, self._entry(pair, total))
            else:
                heapq.heappop(self.heap)
        return None

    def symbol(self, pair: tuple[int, int]) -> int:
        """The symbol that the pair makes."""
        name = self.names[pair[0]] + self.names[pair[1]]
        if name not in self.ids:
            self.ids[name] = len(self.names)
            self.names.append(name)
        return self.ids[name]

    def guess(self, words: Shard, most: int) -> list[Merge]:
        """The next merges, the first for certain. Counts are as before afterwards; ``words`` has the merges applied."""
        true: dict[tuple[int, int], int] = {}
        found: list[Merge] = []
        while len(found) < most and (pair := self.top()) is not None:
            found.append((*pair, self.symbol(pair)))
            total = self.totals[pair]
            a, b, n = words.apply(found[-1])
            changed = dict(zip(zip(a.tolist(), b.tolist()), n.tolist()))
            seen = -changed.get(pair, 0)
            for p, n in [*changed.items(), (pair, 0)]:
                true.setdefault(p, self.totals.get(p, 0))
                self.put(p, 0 if p == pair else self.totals.get(p, 0) + n * total // seen)
        for pair, n in true.items():
            self.put(pair, n)
        return found

    def settle(
        self, guesses: Sequence[Merge], changed: dict[int, list], made: set[int], most: int
    ) -> tuple[list[Merge], list[int], bool]:
        """The next merges in their order with their counts, as far as the guesses hold them, and whether pairs must be counted anew.

        ``changed`` tells what each guess changes after all guesses before it. One that comes earlier than guessed may pass
        those that wait, if none shares a place with it (the end of one is not the start of the other): it merges the same
        places then, only beside the parts of what they will make. What names a waiting symbol counts for its part until it is
        made. Symbols are added to ``made`` until there are ``most``.
        """
        step = {g[:2]: k for k, g in enumerate(guesses)}
        waiting: dict[int, Merge] = {}  # by the symbol, passed by others
        later: dict[int, list[tuple]] = defaultdict(list)  # what to move when a waiting symbol is made
        done, freqs, reach = [], [], 0
        while len(made) < most and (pair := self.top()) in step:
            k = step[pair]
            merge = left, right, new = guesses[k]
            passed = {m[2]: m for m in (*waiting.values(), *guesses[reach:k]) if step[m[:2]] < k}
            if len(passed) < k - sum(step[m[:2]] < k for m in done):  # two make the same symbol
                break
            if passed and (
                new in made or new in passed or any(b == left or a == right or x in made for a, b, x in passed.values())
            ):
                break
            net: dict[tuple[int, int], int] = defaultdict(int)
            for (a, b), n in changed[k]:
                while a in passed:
                    part = passed[a][1]
                    later[a].append(((part, b), (a, b), n))
                    a = part
                while b in passed:
                    part = passed[b][0]
                    later[b].append(((a, part), (a, b), n))
                    b = part
                net[a, b] += n
            for before, after, n in later.pop(new, ()):
                net[before] -= n
                net[after] += n
            waiting.pop(new, None)
            if k >= reach:
                waiting.update((m[2], m) for m in guesses[reach:k])
                reach = k + 1
            done.append(merge)
            freqs.append(self.totals[pair])
            for p, n in net.items():
                self.add(p, n)
            if pair in self.totals:
                raise RuntimeError("a shard does not hold the words that were counted")
            if new in made and self.last:
                return done, freqs, True  # pairs with this symbol may have been too rare to be held
            made.add(new)
        return done, freqs, False


def learn(
    words: DataFrame, alphabet: Sequence[str], fixed: Sequence[str], most_new: int,
    on_round: Callable[[int, int], None] | None = None, most_pairs: int = MOST_PAIRS, rebase_every: int = REBASE_EVERY,
    most_guesses: int = MOST_GUESSES, guess_words: int = GUESS_WORDS,
) -> tuple[list[tuple[str, str, int]], int]:
    """Merges ``(left, right, freq)`` of a table ``ids, freq`` until ``most_new`` new symbols are made; and the rounds.

    ``ids`` index ``alphabet``, :data:`NEVER` for characters outside it; pairs with a symbol of ``fixed`` never merge. The
    result is that of one merge a round. ``on_round`` is told the round and the merges so far.
    """
    spark = words.sparkSession
    names = list(alphabet)
    never = frozenset([NEVER, *(i for i, s in enumerate(names) if s in set(fixed))])
    shown = never - {NEVER}
    shards, path = store(words.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "ids"), "shards")
    state = Learner(names, *pair_totals(shards, shown, names, most_pairs))
    known = shards.orderBy(F.desc("freq"), "ids").limit(guess_words).toArrow()
    frequent = Shard(known["ids"].combine_chunks(), known["freq"].combine_chunks(), never, undoable=True)
    merges, base, rounds, most = [], 0, 0, LEAST_GUESSES
    made: set[int] = set(range(len(names)))
    freqs: list[int] = []
    start = len(made)
    while len(made) < start + most_new:
        guesses = state.guess(frequent, min(most, most_guesses))
        recount = not guesses and state.last is not None
        if not guesses and not recount:
            break
        if guesses:
            rounds += 1
            table = report(shards, never, merges[base:] + guesses, len(merges) - base)
            changed: dict[int, list] = defaultdict(list)
            for k, a, b, n in zip(*(table.column(c).to_pylist() for c in ("step", "a", "b", "n"))):
                changed[k - len(merges) + base].append(((a, b), n))
            right, counted, again = state.settle(guesses, changed, made, start + most_new)
            recount |= again
            same = next((k for k, (g, m) in enumerate(zip(guesses, right)) if g != m), len(right))
            frequent.back_to(len(merges) + same)
            for merge in right[same:]:
                frequent.apply(merge, counted=False)
            merges += right
            freqs += counted
            frequent.settle(len(merges))
            most = max(LEAST_GUESSES, 4 * len(right))
            if on_round:
                on_round(rounds, len(merges))
        if recount or len(merges) - base >= rebase_every:
            superseded = path
            shards, path = store(rebased(shards, never, merges[base:]), "shards")
            discard(spark, superseded)
            base = len(merges)
        if recount:
            state.totals, state.last = pair_totals(shards, shown, names, most_pairs)
            state.fill()
    discard(spark, path)
    return [(names[a], names[b], n) for (a, b, _), n in zip(merges, freqs)], rounds
