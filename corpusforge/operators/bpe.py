"""Exact greedy BPE over a word table of any size, in few Spark jobs.

Greedy BPE picks the most frequent adjacent pair, merges it everywhere and counts again: one job a merge if done word
for word. Here a sequence of merges is *proposed* at once and *proved* in one pass:

* The proposer runs greedy BPE on the most frequent words (a bounded number) with an index from pairs to words, so that
  a merge changes the counts of the pairs in the words it touches only, and on the exact counts of the leading pairs.
* Every word of the table replays the sequence, all words of a batch at once by arrays. A merge that touches it gives,
  for each pair, the change of its count at that step. Summed over all words and added up along the steps this is the
  exact count of every pair at every step. Pairs that never count nearly as much as the last merge are dropped there;
  no step is accepted whose merge counts less than what they may.
* The sequence is right up to the first step at which another pair outranks the chosen one. These merges are accepted;
  the exact counts at that step correct the next proposal, and so do the changes that the words the proposer doesn't see
  made at the later steps. Its first merge is then right, so rounds go on.

Which words the proposer sees changes the number of rounds, never the merges. Ties go to the smallest pair.
"""

from __future__ import annotations

import heapq
from array import array
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import PIECE_SPACE
from ..session import checkpoint_dir
from .rows import Remembered, map_values

SPECIALS = ["<unk>", "<s>", "</s>"]
#: Words that a proposal is worked out from: all, or the most frequent ones and some that stand for the others.
PROPOSAL_WORDS = 1 << 20
#: Leading pairs whose exact counts correct a proposal.
STANDINGS = 1 << 17
#: Symbols that are replayed at once, and changes that a task holds before it adds them up and passes them on.
REPLAYED, HELD = 1 << 20, 1 << 22
#: Changes by unseen words that correct a proposal.
REMAINDERS = 1 << 22
#: Share of the lowest proposed merge's count below which pairs are dropped while a sequence is proved.
SLACK = 0.9
#: The step of a pair that no merge joins.
NEVER = np.iinfo(np.int64).max
Pair = tuple[str, str]


def merged(syms: list[str], pair: Pair) -> list[str]:
    """``syms`` with the pair joined, left to right, without overlaps."""
    out, i, (a, b) = [], 0, pair
    while i < len(syms):
        if syms[i] == a and i + 1 < len(syms) and syms[i + 1] == b:
            out.append(a + b)
            i += 2
        else:
            out.append(syms[i])
            i += 1
    return out


def steps_of(merges: Iterable[Pair]) -> dict[Pair, list[int]]:
    """The steps at which each pair is merged; a pair may come again, since a later merge can spell one of its symbols
    in another way."""
    steps: dict[Pair, list[int]] = defaultdict(list)
    for step, pair in enumerate(merges):
        steps[pair].append(step)
    return dict(steps)


def replay(syms: list[str], steps: dict[Pair, list[int]]) -> Iterator[tuple[int, list[str], list[str]]]:
    """(step, before, after) of every merge that touches a word, in order."""
    at = -1
    while len(syms) > 1:
        best, chosen = None, None
        for pair in zip(syms, syms[1:], strict=False):
            for step in steps.get(pair, ()):
                if step > at:
                    if best is None or step < best:
                        best, chosen = step, pair
                    break
        if best is None:
            return
        after = merged(syms, chosen)
        yield best, syms, after
        syms, at = after, best


def segmented(syms: list[str], steps: dict[Pair, list[int]]) -> list[str]:
    for _, _, syms in replay(syms, steps):
        pass
    return syms


class Proposer:
    """Greedy BPE on some words, with counts that may hold more than these words show.

    All symbols stand in one array, each with the places of its neighbours; a merge looks its pair's places up and changes
    symbols, places and counts by arrays."""

    def __init__(self, words: Iterable[tuple[list[str], int]] | pa.Table, standings: dict[Pair, int], done: Iterable[Pair] = ()):
        """``words`` as (symbols, count), or as a table of these."""
        self.ids: dict[str, int] = {}
        self.names: list[str] = []
        self.later: dict[Pair, list[list[tuple[Pair, int]]]] = {}
        self.least = 0
        if isinstance(words, pa.Table):
            parts = [(*parsed(part.column(0), self.id_of), part.column(1).to_numpy()) for part in words.to_batches(1 << 16)]
            sym, lengths, freqs = (np.concatenate([np.empty(0, dtype=np.int64), *(p[i] for p in parts)]) for i in range(3))
        else:
            flat, lengths, freqs = array("i"), array("q"), array("q")
            for syms, freq in words:
                flat.extend([self.id_of(s) for s in syms])
                lengths.append(len(syms))
                freqs.append(freq)
            sym, lengths, freqs = (np.array(x, dtype=np.int64) for x in (flat, lengths, freqs))
        self.sym = sym.astype(np.int32)
        self.freq = np.repeat(freqs, lengths)
        place = np.arange(len(self.sym), dtype=np.int32)
        self.next, self.prev = place + 1, place - 1  # -1 where a word ends or starts
        ends = np.cumsum(lengths)
        self.next[ends[lengths > 0] - 1] = -1
        self.prev[(ends - lengths)[lengths > 0]] = -1
        self.counts: dict[int, int] = {}
        self.where: dict[int, list[np.ndarray]] = {}
        self.heap: list = []
        self.note(np.flatnonzero(self.next >= 0).astype(np.int32))
        for pair in done:
            self.merge(self.code(pair))
        self.correct(standings)

    def copy(self) -> Proposer:
        out = object.__new__(Proposer)
        out.__dict__.update(self.__dict__)
        out.sym, out.next, out.prev = self.sym.copy(), self.next.copy(), self.prev.copy()
        out.ids, out.names, out.counts = dict(self.ids), list(self.names), dict(self.counts)
        out.where = {c: list(places) for c, places in self.where.items()}
        return out

    def correct(self, standings: dict[Pair, int], most: int | None = None, later: dict[Pair, list[list[tuple[Pair, int]]]] | None = None) -> None:
        """Exact counts of some pairs, and the most that any other counts. ``later``: by merge, what it changes besides, once for
        each time it is chosen."""
        if most is not None:
            self.counts = {c: min(n, most) for c, n in self.counts.items()}
        self.counts.update((self.code(p), n) for p, n in standings.items())
        self.heap = [(-n, self.pair(c), c) for c, n in self.counts.items()]
        heapq.heapify(self.heap)
        self.later = later or {}

    def id_of(self, symbol: str) -> int:
        found = self.ids.setdefault(symbol, len(self.names))
        if found == len(self.names):
            self.names.append(symbol)
        return found

    def code(self, pair: Pair) -> int:
        return self.id_of(pair[0]) << 32 | self.id_of(pair[1])

    def pair(self, code: int) -> Pair:
        return self.names[code >> 32], self.names[code & 0xFFFFFFFF]

    def codes(self, places: np.ndarray) -> np.ndarray:
        """The pairs whose left symbols stand at these places."""
        return self.sym[places].astype(np.int64) << 32 | self.sym[self.next[places]]

    def note(self, places: np.ndarray) -> None:
        """Pairs that have come to stand at these places: counted, and found again."""
        if not len(places):
            return
        codes = self.codes(places)
        order = np.argsort(codes, kind="stable")
        codes, places = codes[order], places[order]
        starts = np.flatnonzero(np.diff(codes, prepend=-1))
        sums = np.add.reduceat(self.freq[places], starts)
        for c, n, a, b in zip(codes[starts].tolist(), sums.tolist(), starts.tolist(), [*starts[1:].tolist(), len(codes)], strict=True):
            self.counts[c] = self.counts.get(c, 0) + n
            self.where.setdefault(c, []).append(places[a:b])

    def merge(self, code: int) -> set[int]:
        """The pairs whose counts change."""
        left, right = code >> 32, code & 0xFFFFFFFF
        places = np.unique(np.concatenate(self.where.pop(code, [np.empty(0, dtype=np.int32)])))
        places = places[(self.sym[places] == left) & (self.next[places] >= 0)]
        places = places[self.sym[self.next[places]] == right]
        if left == right:  # left to right, without overlaps
            chosen, taken = [], -1
            for place, after in zip(places.tolist(), self.next[places].tolist(), strict=True):
                if place != taken:
                    chosen.append(place)
                    taken = after
            places = np.array(chosen, dtype=np.int32)
        changed: set[int] = set()
        if len(places):
            second, before = self.next[places], self.prev[places]
            old = np.unique(np.concatenate([before[before >= 0], places, second[self.next[second] >= 0]]))
            codes, at = np.unique(self.codes(old), return_inverse=True)
            less = np.zeros(len(codes), dtype=np.int64)
            np.add.at(less, at, self.freq[old])
            for c, n in zip(codes.tolist(), less.tolist(), strict=True):
                self.counts[c] -= n
                changed.add(c)
            after = self.next[second]
            self.sym[places] = self.id_of(self.names[left] + self.names[right])
            self.sym[second] = -1
            self.next[places] = after
            self.prev[after[after >= 0]] = places[after >= 0]
            before = self.prev[places]
            new = np.unique(np.concatenate([before[before >= 0], places[self.next[places] >= 0]]))
            changed.update(np.unique(self.codes(new)).tolist())
            self.note(new)
        self.counts[code] = 0
        changed.discard(code)
        return changed

    def propose(self, budget: int, min_count: int) -> list[Pair]:
        """The next merges, at most ``budget``, while a pair counts ``min_count``; ``least`` is the lowest count of them."""
        out, times = [], defaultdict(int)
        while self.heap and len(out) < budget:
            n, pair, code = heapq.heappop(self.heap)
            if -n == self.counts[code] and -n >= min_count:
                self.least = min(-n, self.least) if out else -n
                out.append(pair)
                changed = self.merge(code)
                more = self.later.get(pair, ())
                for other, delta in more[times[pair]] if times[pair] < len(more) else ():
                    c = self.code(other)
                    if c != code:
                        self.counts[c] = self.counts.get(c, 0) + delta
                        changed.add(c)
                times[pair] += 1
                for c in changed:
                    if self.counts[c] >= min_count:
                        heapq.heappush(self.heap, (-self.counts[c], self.pair(c), c))
        return out


def parsed(syms: pa.Array, id_of) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of all words as numbers one after another, and how many each word has."""
    lists = pc.split_pattern(syms, " ")
    coded = lists.flatten().dictionary_encode()
    ids = np.array([id_of(s) for s in coded.dictionary.to_pylist()], dtype=np.int64)
    return ids[coded.indices.to_numpy(zero_copy_only=False)], pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)


def added_up(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted distinct keys, and the sums of the values of each."""
    if not len(keys):
        return keys, *values
    order = np.argsort(keys)
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[starts], *(np.add.reduceat(v[order], starts) for v in values)


@dataclass(frozen=True)
class Numbered:
    """A sequence of merges over numbered symbols; a pair is ``left << bits | right``, a pair at a step ``pair << step_bits | step``."""

    names: list[str]
    ids: dict[str, int]
    pairs: np.ndarray  # of the steps
    made: np.ndarray  # the symbol that each step makes
    joins: np.ndarray  # pairs at their steps, sorted
    bits: int
    step_bits: int

    @staticmethod
    def of(symbols: list[str], merges: list[Pair]) -> Numbered:
        names = sorted({*symbols, *(s for a, b in merges for s in (a, b, a + b))})  # pairs sort like their numbers
        ids = {s: i for i, s in enumerate(names)}
        bits, step_bits = len(names).bit_length(), (len(merges) + 1).bit_length()
        if 2 * bits + step_bits > 63:
            raise ValueError(f"{len(merges)} merges of {len(symbols)} symbols are too many")
        pairs = np.array([ids[a] << bits | ids[b] for a, b in merges], dtype=np.int64)
        made = np.array([ids[a + b] for a, b in merges], dtype=np.int64)
        return Numbered(names, ids, pairs, made, np.sort(pairs << step_bits | np.arange(len(merges))), bits, step_bits)

    def pair(self, code: int) -> Pair:
        return self.names[code >> self.bits], self.names[code & (1 << self.bits) - 1]

    def step_after(self, pairs: np.ndarray, at: np.ndarray | int) -> np.ndarray:
        """The first step after ``at`` that merges each pair."""
        if not len(self.joins):
            return np.full(len(pairs), NEVER)
        place = np.searchsorted(self.joins, (pairs << self.step_bits) + at, side="right")
        found = self.joins[np.minimum(place, len(self.joins) - 1)]
        right = (place < len(self.joins)) & (found >> self.step_bits == pairs)
        return np.where(right, found & (1 << self.step_bits) - 1, NEVER)

    def replayed(self, sym: np.ndarray, lengths: np.ndarray, base: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """(keys, words, sign) of the pairs that come to stand in words or go from them, over the whole sequence. A key is a pair
        at how many steps after ``base`` were taken; what comes before counts as 0."""
        last = np.zeros(len(sym), dtype=bool)
        last[np.cumsum(lengths)[lengths > 0] - 1] = True
        word = np.repeat(np.arange(len(lengths)), lengths)
        lengths = lengths[lengths > 0]
        step, start = np.full(len(sym), NEVER), np.flatnonzero(~last)
        pairs = sym[start] << self.bits | sym[start + 1]
        step[start] = self.step_after(pairs, -1)
        yield pairs << self.step_bits, word[start], 1
        while len(sym):
            low = np.minimum.reduceat(step, np.cumsum(lengths) - lengths)  # of each word
            if (low == NEVER).any():
                on = np.repeat(low < NEVER, lengths)
                sym, last, word, step = sym[on], last[on], word[on], step[on]
                low, lengths = low[low < NEVER], lengths[low < NEVER]
                if not len(sym):
                    return
            at = np.repeat(low, lengths)
            first = np.zeros(len(sym), dtype=bool)
            first[np.cumsum(lengths) - lengths] = True
            left = np.flatnonzero(step == at)
            runs = np.flatnonzero(np.diff(left, prepend=-2) != 1)  # left to right, without overlaps
            left = left[(np.arange(len(left)) - np.repeat(runs, np.diff(runs, append=len(left)))) % 2 == 0]
            right, near = left + 1, left[~first[left]] - 1
            old = np.zeros(len(sym), dtype=bool)
            old[left] = old[near] = old[right[~last[right]]] = True
            old = np.flatnonzero(old)
            yield (sym[old] << self.bits | sym[old + 1]) << self.step_bits | np.maximum(at[old] - base + 1, 0), word[old], -1
            new, stays = np.zeros(len(sym), dtype=bool), np.ones(len(sym), dtype=bool)
            new[left] = new[near] = True
            stays[right] = False
            sym[left], last[left] = self.made[at[left]], last[right]
            lengths = np.add.reduceat(stays, np.cumsum(lengths) - lengths, dtype=np.int64)
            sym, last, word, step, at, new = (x[stays] for x in (sym, last, word, step, at, new))
            step[new & last] = NEVER
            new = np.flatnonzero(new & ~last)
            pairs = sym[new] << self.bits | sym[new + 1]
            step[new] = self.step_after(pairs, at[new])
            yield pairs << self.step_bits | np.maximum(at[new] - base + 1, 0), word[new], 1


CHANGES = "pair long, step int, n long, rest long"


def changes(words: DataFrame, shared, base: int) -> DataFrame:
    """(pair, step, n, rest): by how much each merge of a broadcast ``Numbered`` changes the count of each pair over (syms, freq,
    weight), and how much of it the weights don't show. Step 0 is the count before step ``base``, step k the change by the
    k-th merge from there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book, held = shared.value, []

        def passed() -> pa.RecordBatch:
            keys, n, rest = added_up(*(np.concatenate(x) for x in zip(*held, strict=True))) if held else (np.empty(0, dtype=np.int64),) * 3
            held.clear()
            some = (n != 0) | (rest != 0)
            keys, n, rest = keys[some], n[some], rest[some]
            step = (keys & (1 << book.step_bits) - 1).astype(np.int32)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (keys >> book.step_bits, step, n, rest)], ["pair", "step", "n", "rest"])

        for batch in batches:
            for part in sliced(batch, REPLAYED):
                sym, lengths = parsed(part.column(0), book.ids.__getitem__)
                freq = part.column(1).to_numpy(zero_copy_only=False)
                rest = freq - part.column(2).to_numpy(zero_copy_only=False)
                held.append(added_up(*(np.concatenate(x) for x in zip(*(
                    (keys, sign * freq[word], sign * rest[word]) for keys, word, sign in book.replayed(sym, lengths, base)), strict=True))))
                if sum(len(h[0]) for h in held) >= HELD:
                    yield passed()
        yield passed()

    return words.select("syms", "freq", "weight").mapInArrow(run, CHANGES)


def sliced(batch: pa.RecordBatch, n_bytes: int) -> Iterator[pa.RecordBatch]:
    rows = max(1, batch.num_rows * n_bytes // max(1, batch.column(0).nbytes))
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def timeline(words: DataFrame, shared, base: int, floor: int) -> DataFrame:
    """(pair, step, since, until, before, n, rest): pair counts over the steps of a sequence, of the pairs that count ``floor``
    at some time. A pair counts ``n`` when the merges of the steps ``since`` to ``until`` are chosen; the merge at ``step``
    changed that from ``before``, ``rest`` of it beside the weights. At most one row a pair and step, so a pair has no more
    rows than there are merges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = shared.value
        parts = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches]
        if not sum(len(p[0]) for p in parts):
            return
        pair, step, n, rest = (np.concatenate(x) for x in zip(*parts, strict=True))
        keys, n, rest = added_up(pair << book.step_bits | step, n, rest)
        pair, step = keys >> book.step_bits, keys & (1 << book.step_bits) - 1
        opens = np.concatenate([[True], pair[1:] != pair[:-1]])
        starts = np.flatnonzero(opens)
        sizes = np.diff(starts, append=len(pair))
        total = np.cumsum(n)
        total -= np.repeat((total - n)[starts], sizes)
        until = np.where(np.concatenate([opens[1:], [True]]), len(book.pairs), np.concatenate([step[1:], [0]]) + base - 1)
        kept = np.flatnonzero(np.repeat(np.maximum.reduceat(total, starts) >= floor, sizes))
        for some in (kept[i:i + (1 << 16)] for i in range(0, len(kept), 1 << 16)):
            since = step[some] + base
            columns = pair[some], since - 1, since, until[some], (total - n)[some], total[some], rest[some]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], TIMES)

    return changes(words, shared, base).repartition("pair").mapInArrow(run, ", ".join(f"{c} long" for c in TIMES))


TIMES = ["pair", "step", "since", "until", "before", "n", "rest"]


class Course:
    """The chosen pairs of the steps from ``base`` on with their counts, to be held against any other pair."""

    def __init__(self, chosen: list[Pair], counts: list[int], base: int):
        self.base, self.pairs = base, sorted(set(chosen))
        self.width = 2 * len(self.pairs) + 2
        place = {p: i for i, p in enumerate(self.pairs)}
        self.standing = np.array([n * self.width + self.width - 2 - 2 * place[p] for p, n in zip(chosen, counts, strict=True)], dtype=np.int64)
        self.lows = [self.standing]  # by k: the least standing of 2**k steps
        while 2 << (len(self.lows) - 1) <= len(chosen):
            low, k = self.lows[-1], 1 << (len(self.lows) - 1)
            self.lows.append(np.minimum(low[:-k], low[k:]))

    def standing_of(self, pair: Pair, n: int) -> int:
        """Larger for a pair that counts more or, at equal counts, is smaller."""
        i = bisect_left(self.pairs, pair)
        same = i < len(self.pairs) and self.pairs[i] == pair
        return n * self.width + self.width - 1 - 2 * i - same

    def in_question(self, n: np.ndarray, since: np.ndarray, until: np.ndarray) -> np.ndarray:
        """Which rows of counts reach the least count chosen in their steps; no other can outrank."""
        since, until = since - self.base, np.minimum(until - self.base + 1, len(self.standing))
        rows = np.flatnonzero(since < until)
        power = np.frexp((until - since)[rows])[1] - 1  # exact for whole numbers of this size
        out = np.zeros(len(rows), dtype=bool)
        for k in np.unique(power):
            some = power == k
            low = np.minimum(self.lows[k][since[rows[some]]], self.lows[k][until[rows[some]] - (1 << k)])
            out[some] = n[rows[some]] >= low // self.width
        return rows[out]

    def first_outranked(self, pair: Pair, n: int, since: int, until: int) -> int | None:
        """The first step of ``since`` to ``until`` at which a pair of count ``n`` outranks the chosen one."""
        since, until = since - self.base, min(until - self.base + 1, len(self.standing))
        if since >= until:
            return None
        mine, k = self.standing_of(pair, n), (until - since).bit_length() - 1
        if min(self.lows[k][since], self.lows[k][until - (1 << k)]) >= mine:
            return None
        return self.base + since + int(np.argmax(self.standing[since:until] < mine))


def proved(line: DataFrame, book: Numbered, shared, merges: list[Pair], base: int, floor: int) -> tuple[int, list[int]]:
    """How many of the merges are right, and the counts of those from ``base`` on."""
    spark = line.sparkSession
    steps = [(int(p), base + i) for i, p in enumerate(book.pairs[base:])]
    wanted = spark.createDataFrame(steps, "pair long, step long")
    found = line.join(F.broadcast(wanted), ["pair", "step"]).select("step", "before").toArrow()  # one row a merge
    known = dict(zip(found.column(0).to_pylist(), found.column(1).to_pylist(), strict=True))
    counts = [known.get(step, 0) for step in range(base, len(merges))]
    end = next((base + i for i, n in enumerate(counts) if n < floor), len(merges))
    course = spark.sparkContext.broadcast(Course(merges[base:], counts, base))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book, held, first = shared.value, course.value, end
        for batch in batches:
            pair, since, until, n = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            until = np.minimum(until, first - 1)
            for i in held.in_question(n, since, until).tolist():
                at = held.first_outranked(book.pair(int(pair[i])), int(n[i]), int(since[i]), min(int(until[i]), first - 1))
                first = first if at is None else at
        yield pa.RecordBatch.from_arrays([pa.array([first], pa.int32())], ["first"])

    end = min(end, line.select("pair", "since", "until", "n").mapInArrow(run, "first int").agg(F.min("first")).first()[0])
    return end, counts[:end - base]


def merges_of(words: DataFrame, budget: int, min_count: int = 2) -> list[tuple[Pair, int]]:
    """The first ``budget`` merges of exact greedy BPE over (word, freq, syms) and the count of each when chosen."""
    checkpoint_dir(words.sparkSession)
    words = words.select("word", "freq", "syms").checkpoint()
    return _merges_of(words, [r["piece"] for r in _symbols(words).collect()], budget, min_count)


def _symbols(words: DataFrame) -> DataFrame:
    return (words.select(F.explode(F.split("syms", " ", -1)).alias("piece"), "freq")
            .groupBy("piece").agg(F.sum("freq").cast("long").alias("n")))


def _merges_of(words: DataFrame, symbols: list[str], budget: int, min_count: int) -> list[tuple[Pair, int]]:
    spark = words.sparkSession
    words = weighed(words)
    seen = Proposer(words.where("weight > 0").select("syms", "weight").toArrow(), {})
    done: list[tuple[Pair, int]] = []
    standings: dict[Pair, int] = {}
    later: dict[Pair, list[list[tuple[Pair, int]]]] = {}
    most = None  # what pairs without an exact count may count
    least = None  # the lowest count proposed so far
    full = False  # whether the next round must count all pairs
    while len(done) < budget:
        base = len(done)
        proposer = seen.copy()
        proposer.correct(standings, most, later)
        more = [] if full else proposer.propose(budget - base, min_count)
        least = min(proposer.least, proposer.least if least is None else least)
        floor = max(min_count, int(SLACK * least)) if more else min_count
        del proposer
        sequence = [*(p for p, _ in done), *more]
        book = Numbered.of(symbols, sequence)
        shared = spark.sparkContext.broadcast(book)
        line = timeline(words, shared, base, floor).checkpoint()
        if more:
            end, counts = proved(line, book, shared, sequence, base, floor)
            done += zip(sequence[base:end], counts, strict=True)
            if end == base:
                least //= 2  # it may be that no pair counts as much as was thought
        if len(done) < budget:
            for pair, _ in done[base:]:
                seen.merge(seen.code(pair))
            now = line.where((F.col("since") <= len(done)) & (F.col("until") >= len(done)) & (F.col("n") >= min_count))
            now = now.orderBy(F.desc("n"), "pair").limit(STANDINGS).select("pair", "n").toArrow()
            standings = {book.pair(p): n for p, n in zip(*(c.to_pylist() for c in now.columns), strict=True)}
            most = max(floor, min(standings.values()) if len(standings) == STANDINGS else 0) - 1
            later = _later(line, book, sequence, len(done))
            if not standings and floor == min_count:
                break
            full = not standings
    return done


def weighed(words: DataFrame) -> DataFrame:
    """(syms, freq, weight) with the weights of the words that a proposal is worked out from: half of ``PROPOSAL_WORDS`` are the
    most frequent ones, the others stand for a share of the rest, chosen by hash, each for as many. Whole classes of equal
    counts are taken, of which there are at most the root of twice the tokens."""
    sizes = sorted((r["freq"], r["count"]) for r in words.groupBy("freq").count().collect())
    total = room = sum(n for _, n in sizes)
    if total > PROPOSAL_WORDS:
        room = PROPOSAL_WORDS // 2
    least = sizes[-1][0] + 1 if sizes else 0
    while sizes and sizes[-1][1] <= room:
        least, n = sizes.pop()
        room -= n
    each = -(-sum(n for _, n in sizes) // max(1, PROPOSAL_WORDS // 2))  # 0 where all are seen
    some = F.when(F.pmod(F.xxhash64("word"), F.lit(max(1, each))) == 0, F.col("freq") * each).otherwise(0)
    return words.select("syms", "freq", F.when(F.col("freq") >= least, F.col("freq")).otherwise(some).cast("long").alias("weight"))


def _later(line: DataFrame, book: Numbered, sequence: list[Pair], start: int) -> dict[Pair, list[list[tuple[Pair, int]]]]:
    """By merge of the steps from ``start`` on: what it changes in words that the proposer does not see."""
    rows = line.where((F.col("step") >= start) & (F.col("rest") != 0)).select("step", "pair", "rest").limit(REMAINDERS).toArrow()
    by_step: dict[int, list[tuple[Pair, int]]] = defaultdict(list)
    for step, pair, n in zip(*(c.to_pylist() for c in rows.columns), strict=True):
        by_step[step].append((book.pair(pair), n))
    out: dict[Pair, list[list[tuple[Pair, int]]]] = defaultdict(list)
    for step in range(start, len(sequence)):
        out[sequence[step]].append(by_step.get(step, []))
    return out


def bpe_learn(words: DataFrame, vocab_size: int, min_count: int = 2) -> tuple[DataFrame, DataFrame]:
    """Learn merges until the vocabulary (specials + characters + merges) reaches ``vocab_size`` or no pair counts
    ``min_count``.

    Returns ``(vocab, words)``: vocab ``(id, piece, kind, rank, n, left, right)`` and the word table with final symbols.
    The merges are those of sequential greedy BPE (ties: smallest pair). A ``vocab_size`` that leaves no room for a
    merge beside the specials and all characters raises ValueError.
    """
    spark = words.sparkSession
    checkpoint_dir(spark)
    words = words.select("word", "freq", "syms").checkpoint()  # counted once, read several times
    char_rows = _symbols(words).orderBy(F.col("n").desc(), "piece").collect()  # character inventory: bounded
    budget = vocab_size - len(SPECIALS) - len(char_rows)
    if char_rows and budget <= 0:
        raise ValueError(f"a vocabulary of {vocab_size} has no room for merges beside {len(SPECIALS)} specials and {len(char_rows)} characters")
    done = _merges_of(words, [r["piece"] for r in char_rows], budget, min_count) if char_rows else []
    rows = [(i, p, "special", None, None, None, None) for i, p in enumerate(SPECIALS)]
    rows += [(len(rows) + i, r["piece"], "char", None, int(r["n"]), None, None) for i, r in enumerate(char_rows)]
    rows += [(len(rows) + i, a + b, "merge", i, n, a, b) for i, ((a, b), n) in enumerate(done)]
    # the vocabulary is bounded by vocab_size rows
    vocab = spark.createDataFrame(rows, "id int, piece string, kind string, rank int, n long, left string, right string")
    shared = spark.sparkContext.broadcast(steps_of(p for p, _ in done))
    final = map_values(words, F.col("syms"), "syms", T.StringType(),
                       lambda: lambda syms: " ".join(segmented(syms.split(" "), shared.value)))
    return vocab, final


def bpe_encode(lines: DataFrame, vocab: DataFrame, text_col: str = "line", out_col: str = "pieces") -> DataFrame:
    """``lines`` with the pieces of each line's words, joined by spaces. The merges (at most the vocabulary's size) go to
    every task, which replays them once for each word it meets; lines are neither split up nor shuffled. A null line
    gives the empty string."""
    rows = vocab.where(F.col("kind") == "merge").orderBy("rank").select("left", "right").collect()
    shared = lines.sparkSession.sparkContext.broadcast(steps_of((r["left"], r["right"]) for r in rows))

    def make():
        pieces = Remembered(lambda word: " ".join(segmented(list(PIECE_SPACE + word), shared.value)))
        return lambda text: " ".join(map(pieces.__getitem__, (text or "").split()))

    return map_values(lines, F.col(text_col).cast("string"), out_col, T.StringType(), make)
