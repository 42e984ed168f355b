"""Exact byte-pair-encoding training in few passes over the word types (SUB1).

Plain training counts all adjacent symbol pairs, merges the most frequent one and starts
again: one pass per merge.  Here a round takes as many merges as are certain to be the ones that plain training would make next.

The driver has an index of the most frequent pairs (at most ``INDEX``) with exact counts; blocks of word types, as symbol
numbers weighted by word frequency, stay with the tasks.  A round counts, around the most frequent pairs, the triples
``x a b`` that a merge of ``a b`` would change.  From these ``leading_merges`` keeps bounds on every pair's count while it
commits merges: a merge lowers the counts of ``x a`` and ``b y``, by exactly the triple's count if no earlier merge of the
round can have touched the triple, and makes new pairs that are at most as frequent as the triple.  It stops as soon as two
bounds overlap, a new pair could be the most frequent, or the next pair is less frequent than those it was given.  So the
merges are those of plain training, whatever the number of merges per round.  Then the blocks take all merges of the
round in one step, and the tasks report by how much that changed the pairs' counts, which brings the index up to date.
Pairs are counted anew only when the index has no pair left that is more frequent than those it leaves out.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusforge.session import discard, map_arrow, materialize, release, stored

# Pairs whose counts the driver keeps, at most.
INDEX = 200_000
# Pairs that a round looks at, about: all those as frequent as the last are taken, too, up to ``MOST`` in all.
TOP, MOST = 1024, 8192
# Word types of a block, and symbols after which a block is closed.
BLOCK_WORDS, BLOCK_SYMBOLS = 20_000, 1 << 20
# Rounds after which the blocks are written anew.
CHECKPOINT_EVERY = 12
# Keys that a task sums before it hands them on, about.
SUMMED_AT_ONCE = 1 << 21
_END = -1


def leading_merges(pairs: list[tuple[int, int, int]], triples: list[tuple[int, int, int, int]], names: list[str],
                   last: tuple, limit: int, min_count: int) -> tuple[list[tuple[int, int]], dict[tuple[int, int], int] | None]:
    """The next merges of plain training, as many as are certain and at most ``limit``; and the pairs that they can have
    made, with bounds on their counts (None if the last merge has them all counted anew).

    ``pairs``: the most frequent ``(a, b, n)``.  Training order is by falling count, then by the symbols' ``names``; no pair that is not
    given comes before ``last``, a ``(-count, name, name)``.  ``triples``: ``(x, a, b, n)`` of neighbours around the pairs; those left out
    hold a pair that is not given, and pairs as frequent as they are come behind ``last``.
    """
    low = {(a, b): n for a, b, n in pairs}
    high = dict(low)
    before, behind = defaultdict(list), defaultdict(list)  # of a pair: what stands left of it, right of it
    for x, a, b, n in triples:
        before[a, b].append((x, n))
        behind[x, a].append((b, n))
    names = list(names)
    taken = set(names)
    queue = [(-n, names[a], names[b], (a, b)) for (a, b), n in high.items()]
    heapq.heapify(queue)
    first_new = len(names)
    starts, ends, merged = defaultdict(list), defaultdict(list), set()  # merges of the round by their left and right symbol
    out: list[tuple[int, int]] = []

    def push(p: tuple[int, int]) -> None:
        heapq.heappush(queue, (-high[p], names[p[0]], names[p[1]], p))

    def head() -> tuple | None:
        while queue and (queue[0][3] not in high or -queue[0][0] != high[queue[0][3]]):
            heapq.heappop(queue)
        return queue[0] if queue else None

    def born(left: int, right: int, most: int) -> None:
        p = (left, right)
        high[p] = high.get(p, 0) + most
        low.setdefault(p, 0)
        push(p)

    while len(out) < limit and (top := head()) is not None:
        p = a, b = top[3]
        if max(p) >= first_new:
            break
        heapq.heappop(queue)
        mine = (-low[p], names[a], names[b])
        rival = head()
        if low[p] < min_count or mine > last or (rival is not None and mine > rival[:3]):
            break
        del high[p], low[p]
        out.append(p)
        product = names[a] + names[b]
        if a == b or product in taken:
            return out, None  # runs of one symbol, and symbols that other merges make as well, are counted anew
        taken.add(product)
        names.append(product)
        s = len(names) - 1
        # a triple is as it was if nothing can have taken one of its symbols to another neighbour
        for x, n in before[p]:
            if (x, a) in merged:
                continue
            exact = not ends[x] and not starts[b] and x not in p
            if (x, a) in high:
                low[x, a] -= n
                high[x, a] -= n if exact else 0
                push((x, a))
            born(x, s, n)
            if x == b:
                born(s, s, n)
            for made in ends[x]:
                born(made, s, n)
        for y, n in behind[p]:
            if (b, y) in merged:
                continue
            exact = not ends[a] and not starts[y] and y not in p
            if (b, y) in high:
                low[b, y] -= n
                high[b, y] -= n if exact else 0
                push((b, y))
            born(s, y, n)
            for made in starts[y]:
                born(s, made, n)
        merged.add(p)
        starts[a].append(s)
        ends[b].append(s)
    return out, {p: n for p, n in high.items() if max(p) >= first_new}


def merge_block(symbols: np.ndarray, merges: list[tuple[int, int, int]]) -> np.ndarray:
    """All merges ``(a, b, product)`` of a round, one after another; a pair of one symbol twice comes last.

    No merge has a symbol that another one of them makes, so only their order where they overlap matters: a
    place is merged if no overlapping place comes earlier.
    """
    runs = merges[-1] if merges and merges[-1][0] == merges[-1][1] else None
    merges = merges[:-1] if runs else merges
    if merges:
        code = np.array([(a << 32) | b for a, b, _ in merges])
        order = np.argsort(code)
        code = code[order]
        lefts = np.zeros(int(max(symbols.max(initial=0), code[-1] >> 32)) + 2, dtype=bool)  # the end mark -1 finds the last place
        lefts[code >> 32] = True
        hit = np.flatnonzero(lefts[symbols[:-1]])
        here = (symbols[hit].astype(np.int64) << 32) | (symbols[hit + 1].astype(np.int64) & 0xFFFFFFFF)
        found = np.searchsorted(code, here)
        same = code[np.minimum(found, len(code) - 1)] == here
        hit, rank = hit[same], order[found[same]]
        chosen = []
        while len(hit):
            near = np.diff(hit) == 1
            least = np.ones(len(hit), dtype=bool)
            least[1:] &= ~(near & (rank[:-1] < rank[1:]))
            least[:-1] &= ~(near & (rank[1:] < rank[:-1]))
            chosen.append((hit[least], rank[least]))
            gone = least.copy()
            gone[1:] |= near & least[:-1]
            gone[:-1] |= near & least[1:]
            hit, rank = hit[~gone], rank[~gone]
        if chosen:
            at, which = (np.concatenate(x) for x in zip(*chosen))
            symbols = symbols.copy()
            symbols[at] = np.array([s for *_, s in merges], dtype=np.int32)[which]
            keep = np.ones(len(symbols), dtype=bool)
            keep[at + 1] = False
            symbols = symbols[keep]
    if runs:
        a, _, s = runs
        hit = np.flatnonzero((symbols[:-1] == a) & (symbols[1:] == a))
        if len(hit):
            first = np.ones(len(hit), dtype=bool)
            first[1:] = np.diff(hit) > 1
            begin = np.flatnonzero(first)
            place = np.arange(len(hit)) - np.repeat(begin, np.diff(np.append(begin, len(hit))))
            at = hit[place % 2 == 0]
            symbols = symbols.copy()
            symbols[at] = s
            keep = np.ones(len(symbols), dtype=bool)
            keep[at + 1] = False
            symbols = symbols[keep]
    return symbols


def _weights(symbols: np.ndarray, freq: np.ndarray) -> np.ndarray:
    """The frequency of the word that each symbol belongs to (and of a word's end mark)."""
    ends = np.flatnonzero(symbols == _END)
    return np.repeat(freq, np.diff(np.concatenate([[-1], ends])))


def _summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, weights = keys[order], weights[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(weights, first) if len(first) else weights[:0]


class Summed:
    """Sums by key over the blocks of a task, so that a key is handed on once and not by each block that has it."""

    def __init__(self):
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = self.least = 0

    def add(self, keys: np.ndarray, n: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Sums to hand on now: none as long as there is room."""
        self.held.append((keys, n))
        self.size += len(keys)
        if self.size < SUMMED_AT_ONCE + self.least:
            return []
        keys, n = self._sums()
        if len(keys) >= SUMMED_AT_ONCE:
            return [(keys, n)]
        self.held, self.size, self.least = [(keys, n)], len(keys), len(keys)
        return []

    def _sums(self) -> tuple[np.ndarray, np.ndarray]:
        keys, n = (np.concatenate(x) for x in zip(*self.held))
        self.held, self.size, self.least = [], 0, 0
        return _summed(keys, n)

    def rest(self) -> list[tuple[np.ndarray, np.ndarray]]:
        return [self._sums()] if self.held else []


def _pair_codes(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs, and their codes."""
    at = np.flatnonzero((symbols[:-1] != _END) & (symbols[1:] != _END))
    return at, (symbols[at].astype(np.int64) << 32) | symbols[at + 1].astype(np.int64)


def pack(words: DataFrame, chars: list[str]) -> DataFrame:
    """Blocks ``symbols, freq`` of ``(word, freq)``: numbers of characters, every word closed by an end mark."""
    number = {c: i for i, c in enumerate(chars)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols: list[int] = []
        freq: list[int] = []

        def block() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([np.array(symbols, dtype="<i4").tobytes()], pa.binary()),
                                               pa.array([np.array(freq, dtype="<i8").tobytes()], pa.binary())], ["symbols", "freq"])

        for b in batches:
            for word, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                symbols.extend(map(number.__getitem__, word))
                symbols.append(_END)
                freq.append(n)
                if len(freq) >= BLOCK_WORDS or len(symbols) >= BLOCK_SYMBOLS:
                    yield block()
                    symbols, freq = [], []
        if freq:
            yield block()

    return map_arrow(words.select("word", "freq"), run, "symbols binary, freq binary")


def _blocks(batches: Iterator[pa.RecordBatch], steps: Steps) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for b in batches:
        for s, f in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            symbols = np.frombuffer(s, dtype="<i4")
            for merges in steps:
                symbols = merge_block(symbols, merges)
            yield symbols, np.frombuffer(f, dtype="<i8")


Steps = list[list[tuple[int, int, int]]]  # merges ``(a, b, product)`` of rounds that the stored blocks have not taken yet


def _merged(blocks: DataFrame, steps: Steps) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for symbols, freq in _blocks(batches, steps):
            yield pa.RecordBatch.from_arrays([pa.array([symbols.astype("<i4").tobytes()], pa.binary()),
                                              pa.array([freq.tobytes()], pa.binary())], ["symbols", "freq"])

    return map_arrow(blocks, run, "symbols binary, freq binary")


def _sums(rows: DataFrame, blocks: DataFrame, *keys: str) -> DataFrame:
    """Sums of ``n`` by key, in as many partitions as the blocks have: blocks have summed their own rows, and hundreds of shuffle
    partitions would cost a round more than its work."""
    return rows.repartition(_tasks(blocks), *keys).groupBy(*keys).agg(F.sum("n").alias("n"))


def _tasks(blocks: DataFrame) -> int:
    return max(1, blocks.rdd.getNumPartitions())


def _counted(blocks: DataFrame, steps: Steps) -> DataFrame:
    """``code, n`` of every pair; a code is the left symbol times 2**32 plus the right one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Summed()

        def rows(found):
            for code, n in found:
                yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], ["code", "n"])

        for symbols, freq in _blocks(batches, steps):
            at, code = _pair_codes(symbols)
            yield from rows(sums.add(*_summed(code, _weights(symbols, freq)[at])))
        yield from rows(sums.rest())

    return _sums(map_arrow(blocks, run, "code bigint, n bigint"), blocks, "code")


def _round(blocks: DataFrame, steps: Steps, merges: list[tuple[int, int, int]], first_new: int, least: int,
           next_pairs: list[tuple[int, int]]) -> tuple[dict[int, int], list[tuple[int, int, int, int]]]:
    """By how much the merges change the counts of pairs, by code (new pairs rarer than ``least`` are left out), and the triples with two
    of ``next_pairs`` after the merges."""
    codes = np.array([(a << 32) | b for a, b in next_pairs], dtype=np.int64)
    order = np.argsort(codes)
    ordered = codes[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        changed, near = Summed(), Summed()

        def rows(what, found):
            for key, n in found:
                key, n = key[n != 0], n[n != 0]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), what, np.int8)), pa.array(key), pa.array(n)], ["what", "key", "n"])

        for symbols, freq in _blocks(batches, steps):
            touched, weight = _touched(symbols, freq, merges)
            if len(touched):
                after = merge_block(touched, merges)
                (at0, code0), (at1, code1) = _pair_codes(touched), _pair_codes(after)
                code, n = _summed(np.concatenate([code0, code1]), np.concatenate([-_weights(touched, weight)[at0], _weights(after, weight)[at1]]))
                yield from rows(0, changed.add(code[n != 0], n[n != 0]))
            if len(ordered):
                yield from rows(1, near.add(*_triple_keys(merge_block(symbols, merges), freq, ordered, order, True)))
        yield from rows(0, changed.rest())
        yield from rows(1, near.rest())

    out = _sums(map_arrow(blocks, run, "what tinyint, key bigint, n bigint"), blocks, "what", "key")
    new = (F.col("key") >= first_new << 32) | (F.col("key").bitwiseAND(0xFFFFFFFF) >= first_new)
    got = out.filter((F.col("what") == 1) | ~new | (F.col("n") >= least)).toArrow()
    rows = list(zip(got["what"].to_pylist(), got["key"].to_pylist(), got["n"].to_pylist()))
    triples = [(k, n) for what, k, n in rows if what]
    return {k: n for what, k, n in rows if not what}, _spell_triples([k for k, _ in triples], [n for _, n in triples], next_pairs)


def _touched(symbols: np.ndarray, freq: np.ndarray, merges: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """The words that hold a pair of the merges, and their frequencies."""
    code = np.sort(np.array([(a << 32) | b for a, b, _ in merges]))
    at, here = _pair_codes(symbols)
    hit = at[code[np.minimum(np.searchsorted(code, here), len(code) - 1)] == here]
    ends = np.flatnonzero(symbols == _END)
    words = np.unique(np.searchsorted(ends, hit))
    begin = np.concatenate([[0], ends[:-1] + 1])[words] if len(words) else words
    size = ends[words] + 1 - begin
    place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin, size)
    return symbols[place], freq[words]


_RIGHT, _BOTH = 1 << 62, 1 << 61  # marks of a triple's key


def _triple_keys(symbols: np.ndarray, freq: np.ndarray, ordered: np.ndarray, order: np.ndarray, closed: bool) -> tuple[np.ndarray, np.ndarray]:
    """Keys and weights of the triples of a block that hold two of the pairs (or one, unless ``closed``): the number of one of its pairs and the other symbol."""
    at, code = _pair_codes(symbols)
    if not len(at) or not len(ordered):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    found = np.minimum(np.searchsorted(ordered, code), len(ordered) - 1)
    which = np.where(ordered[found] == code, order[found], -1)
    weight = _weights(symbols, freq)[at]
    next_ = np.flatnonzero(np.diff(at) == 1)  # pairs whose second symbol begins the next pair
    x, y = which[next_], which[next_ + 1]
    first = x >= 0
    use = np.flatnonzero(first & (y >= 0) if closed else first | (y >= 0))
    next_, x, y, first = next_[use], x[use], y[use], first[use]
    key = np.where(first, _RIGHT | np.where(y >= 0, _BOTH, 0) | (x << 32) | symbols[at[next_ + 1] + 1], (y << 32) | symbols[at[next_]])
    return _summed(key.astype(np.int64), weight[next_])


def _spell_triples(keys: list[int], counts: list[int], pairs: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
    out = []
    for key, n in zip(keys, counts):
        a, b = pairs[(key >> 32) & ((1 << 29) - 1)]
        other = key & 0xFFFFFFFF
        out.append((a, b, other, n) if key & _RIGHT else (other, a, b, n))
    return out


def _triples(blocks: DataFrame, steps: Steps, pairs: list[tuple[int, int, int]], closed: bool) -> list[tuple[int, int, int, int]]:
    """Triples with two of the pairs, and unless ``closed`` those with one that are as frequent as the last pair."""
    codes = np.array([(a << 32) | b for a, b, _ in pairs])
    order = np.argsort(codes)
    ordered = codes[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Summed()

        def rows(found):
            for key, n in found:
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], ["key", "n"])

        for symbols, freq in _blocks(batches, steps):
            yield from rows(sums.add(*_triple_keys(symbols, freq, ordered, order, closed)))
        yield from rows(sums.rest())

    found = _sums(map_arrow(blocks, run, "key bigint, n bigint"), blocks, "key")
    if not closed:
        found = found.filter((F.col("n") >= pairs[-1][2]) | (F.col("key").bitwiseAND(_BOTH) != 0))
    got = found.toArrow()
    return _spell_triples(got["key"].to_pylist(), got["n"].to_pylist(), [p[:2] for p in pairs])


class PairIndex:
    """Exact counts of the most frequent pairs; no other pair is more frequent than ``least``."""

    def __init__(self, blocks: DataFrame, steps: Steps, size: int):
        rows = _counted(blocks, steps).orderBy(F.desc("n"), "code").limit(size).toArrow()
        self.codes, self.n = rows["code"].to_numpy().copy(), rows["n"].to_numpy().copy()
        self.least = int(self.n[-1]) if len(self.n) == size else 0
        self.stale = False
        self.at = dict(zip(self.codes.tolist(), range(len(self.codes))))

    def update(self, changes: dict[int, int], first_new: int) -> None:
        """Add changes; a pair of old symbols that grew although the index does not have it makes the index stale."""
        born: list[tuple[int, int]] = []
        for code, n in changes.items():
            i = self.at.get(code)
            if i is not None:
                self.n[i] += n
            elif n > 0 and self.least > 0 and max(code >> 32, code & 0xFFFFFFFF) < first_new:
                self.stale = True
            elif n > 0:
                self.at[code] = len(self.codes) + len(born)
                born.append((code, n))
        if born:
            codes, n = (np.array(x, dtype=np.int64) for x in zip(*born))
            self.codes, self.n = np.concatenate([self.codes, codes]), np.concatenate([self.n, n])

    def leading(self, names: list[str], top: int, most: int, cut: int | None = None) -> tuple[list[tuple[int, int, int]], tuple, bool]:
        """The most frequent pairs in training order (about ``top``, or all with a count of at least ``cut``), what no other pair comes before,
        and whether all pairs as frequent as the last are among them."""
        certain = np.flatnonzero(self.n > self.least)
        if not len(certain):
            return [], (), True
        n = self.n[certain]
        closed = True
        if cut is None:
            cut = int(np.partition(n, len(n) - top)[len(n) - top]) if len(n) > top else int(n.min())
            closed = np.count_nonzero(n >= cut) <= most
            if not closed and (n > cut).any():
                closed, cut = True, int(n[n > cut].min())
        chosen = certain[n >= cut]
        rows = sorted(((int(c >> 32), int(c & 0xFFFFFFFF), int(k)) for c, k in zip(self.codes[chosen], self.n[chosen])),
                      key=lambda r: (-r[2], names[r[0]], names[r[1]]))
        if closed:
            return rows, (-cut, "\U0010ffff", ""), True
        rows = rows[:top]
        return rows, (-rows[-1][2], names[rows[-1][0]], names[rows[-1][1]]), False

    def next_pairs(self, merged: list[tuple[int, int]], born: dict[tuple[int, int], int], top: int, most: int) -> tuple[list[tuple[int, int]], int]:
        """Pairs among which the ``top`` most frequent will be after the merges, and the count that a pair must have to be one; none if
        they are too many.  Old pairs only get rarer, and ``born`` bounds the counts of new ones."""
        skip = {(a << 32) | b for a, b in merged}
        certain = np.flatnonzero(self.n > self.least)
        n = self.n[certain]
        if not len(n):
            return [], 0
        top = top + len(skip)
        cut = max(self.least + 1, int(np.partition(n, len(n) - top)[len(n) - top]) if len(n) > top else int(n.min()))
        if np.count_nonzero(n >= cut) > most:
            return [], 0
        old = [(c >> 32, c & 0xFFFFFFFF) for c in self.codes[certain[n >= cut]].tolist() if c not in skip]
        new = [p for p, k in born.items() if k >= cut]
        return (old + new, cut) if old and len(old) + len(new) <= most else ([], 0)


def train(words: DataFrame, chars: list[str], budget: int, merges_per_round: int, min_count: int) -> tuple[list[tuple[str, str]], DataFrame, int]:
    """Merges in training order, the segmented words ``(word, freq, pieces)``, and the number of rounds.

    ``words``: distinct ``(word, freq)``; ``chars``: all their characters.
    """
    names, number = list(chars), {c: i for i, c in enumerate(chars)}
    first = blocks = materialize(pack(words, chars))
    merges: list[tuple[str, str]] = []
    rounds = 0
    steps: Steps = []
    index = PairIndex(blocks, steps, INDEX)
    triples, cut = None, 0  # triples around all pairs with a count of at least ``cut``, if the round before has counted them
    while len(merges) < budget:
        found, last, closed = index.leading(names, TOP, MOST, cut if triples is not None else None)
        if triples is not None and not found:
            triples = None
            continue
        if (not found and index.least >= min_count) or index.stale:
            index, triples = PairIndex(blocks, steps, INDEX), None
            while not (index.n > index.least).any() and len(index.n):  # more equally frequent pairs than the index holds
                index = PairIndex(blocks, steps, 2 * len(index.n))
            found, last, closed = index.leading(names, TOP, MOST)
        if not found or found[0][2] < min_count:
            break
        limit = min(merges_per_round, budget - len(merges))
        if triples is None:
            triples = _triples(blocks, steps, found, closed) if limit > 1 else []
        taken, born = leading_merges(found, triples, names, last, limit, min_count)
        if not taken:  # no pair as frequent as ``cut`` is left
            triples = None
            continue
        first_new, step = len(names), []
        for a, b in taken:
            product = names[a] + names[b]
            if product not in number:
                number[product] = len(names)
                names.append(product)
            merges.append((names[a], names[b]))
            step.append((a, b, number[product]))
        rounds += 1
        ahead, cut = index.next_pairs(taken, born, TOP, MOST) if born is not None and limit > 1 else ([], 0)
        changes, triples = _round(blocks, steps, step, first_new, max(1, index.least), ahead)
        index.update(changes, first_new)
        if not ahead:
            triples = None
        steps = [*steps, step]
        if len(steps) == CHECKPOINT_EVERY:
            before, blocks, steps = blocks, stored(_merged(blocks, steps), "blocks"), []
            if before is not first:
                discard(before)
            release(words.sparkSession)
    before, blocks = blocks, materialize(_merged(blocks, steps))
    if before is not first:
        discard(before)

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for symbols, freq in _blocks(batches, []):
            ends = np.flatnonzero(symbols == _END)
            pieces = [names[i] for i in symbols.tolist() if i != _END]
            cuts = np.concatenate([[0], ends - np.arange(len(ends))]).astype(np.int32)
            words_ = ["".join(pieces[i:j]) for i, j in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(words_, pa.string()), pa.array(freq), pa.ListArray.from_arrays(cuts, pa.array(pieces, pa.string()))],
                                             ["word", "freq", "pieces"])

    return merges, map_arrow(blocks, spelled, "word string, freq bigint, pieces array<string>"), rounds
