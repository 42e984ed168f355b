"""N-gram Jaccard join by parity sketches.

A document is the set of the 64-bit hashes of its word n-grams.  The hash space
is cut into blocks, four times as many from one size band to the next; a block's parity sketch has
one bit per hash value, flipped by each n-gram, and is kept as the XOR of its set bits'
digests.  The Hamming distance of two sketches is the symmetric difference D of the sets
(with fewer bits: at most D), and a similarity of at least ``num/den`` bounds D by
``(den-num)(a+b)/(den+num)`` for sizes a and b.  D differing n-grams change at most D blocks, so two
similar documents agree on all their filled blocks but D: in a common order of
block keys they share one of the first D + 1.  Pairs that share a key are pruned by the
distance of short sketches and verified on the whole sets.

Documents with equal sets are one node.  Keys met in many documents come last in the
order of keys, so that only documents made of little else use them.  A bucket with more
than ``HOT`` nodes is compared with its smallest node first; then, of buckets with the same members one, the nodes
outside the bucket's main component are compared with the others in blocks: by their sketches first, which leaves the members
that some sketch does not rule out, and these by their whole sets, a pair in the first bucket where it meets.  A block hands on
a link only if it joins two components that its earlier links did not, so its rows grow with its members and not with their pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusforge.llm import words
from corpusforge.llm.common import broadcast_if_small, in_arrow, slices, stored, text_buffer
from corpusforge.llm.components import components

NGRAM = 5
NUM, DEN = 75, 100
# A band with m blocks (a power of four) takes sizes of FILL[0] * m to FILL[1] * m.
FILL = (0.6, 3.2)
HOT = 24
# Nodes outside their bucket's main component that a task holds while the others of the bucket pass by, and others at a time.
CHUNK, PASSING = 1024, 128
# N-grams that the held nodes have together, about.
HELD_GRAMS = 1 << 22
# Open buckets that a node knows of when it passes through one of them; two nodes that share more may be compared again.
KNOWN_BUCKETS = 64
# At most so many keys go last, those met most often; which ones they are never changes the result.
MAX_LATE = 1 << 16
# Slices of text after which a task reports the keys it met more than once.
WINDOW_SLICES = 16
# Rows of sorted keys that a task holds at a time.
GROUP_ROWS = 50_000
# Keys met once are dropped at the source by a bit map of this size.
SIEVE_BITS = 1 << 26
# Nodes that a task remembers to have shown, at most; a node beyond that may come twice.
SEEN = 1 << 20
_SPACES = words.space_classes()
_MULTIPLIERS = words.numbers(64, 3) | np.uint64(1)


def ngram_sets(data: np.ndarray, offsets: np.ndarray, n: int = NGRAM) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct n-grams of each text, ordered; a shorter text is one n-gram."""
    w = words.split(data, offsets, _SPACES)
    rows = len(offsets) - 1
    count = np.bincount(w.doc, minlength=rows)
    begin = np.cumsum(count) - count
    many = len(w.code) - n + 1
    with np.errstate(over="ignore"):
        if many > 0:
            total = np.zeros(many, dtype=np.uint64)
            for j in range(n):
                total += w.code[j:j + many] * _MULTIPLIERS[j]
            whole = w.doc[:many] == w.doc[n - 1:]
            doc, code = w.doc[:many][whole], words.mix(total[whole])
        else:
            doc, code = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        short = np.flatnonzero((count > 0) & (count < n))
        if len(short):
            codes = []
            for r in short:
                part = w.code[begin[r]:begin[r] + count[r]]
                codes.append(np.uint64((part * _MULTIPLIERS[:len(part)]).sum(dtype=np.uint64) + _MULTIPLIERS[32 + len(part)]))
            doc, code = np.concatenate([doc, short]), np.concatenate([code, words.mix(np.array(codes, dtype=np.uint64))])
        order = np.argsort(doc, kind="stable")
        doc, code = doc[order], code[order]
    ends = np.searchsorted(doc, np.arange(rows + 1)).tolist()
    for at, end in zip(ends, ends[1:]):
        code[at:end].sort()
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (code[1:] != code[:-1])
    return doc[new], code[new]


def nodes_of(doc: np.ndarray, code: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit digest of each set, and its size."""
    size = np.bincount(doc, minlength=rows)
    ends = np.concatenate([[0], np.cumsum(size)])
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words.mix(code + np.uint64(11)), dtype=np.uint64)])
        digest = words.mix(sums[ends[1:]] - sums[ends[:-1]] + size.astype(np.uint64) * _MULTIPLIERS[63])
    return digest, size


def _leading(doc: np.ndarray, key: np.ndarray, late: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Whether a key is among its document's first ``most + 1``, those that are not late first, by value (without the lowest bit;
    of equal ones all); ``doc`` ascends."""
    place = (key >> np.uint64(1)) | (late.astype(np.uint64) << np.uint64(63))
    last = np.full(len(most), np.iinfo(np.uint64).max, dtype=np.uint64)
    ends = np.searchsorted(doc, np.arange(len(most) + 1))
    for r in np.flatnonzero(np.diff(ends) > most + 1).tolist():
        last[r] = np.partition(place[ends[r]:ends[r + 1]], most[r])[most[r]]
    return place <= last[doc]


def block_keys(doc: np.ndarray, code: np.ndarray, size: np.ndarray, hot: np.ndarray, num: int = NUM, den: int = DEN) -> tuple[np.ndarray, np.ndarray]:
    """(text, key) of the block keys that a document must show, for all its bands; ``hot`` keys (sorted) go last."""
    out_doc, out_key = [], []
    safe = np.maximum(size, 1)
    lowest = 2 * np.maximum(0, np.ceil(np.log2(safe / FILL[1]) / 2)).astype(np.int64)
    lowest += 2 * (safe > FILL[1] * 2.0 ** lowest)

    def late(key: np.ndarray) -> np.ndarray:
        if not len(hot):
            return np.zeros(len(key), dtype=bool)
        return hot[np.minimum(np.searchsorted(hot, key), len(hot) - 1)] == key

    for step in (0, 2):
        band = lowest + step
        inside = (size > 0) & (safe >= FILL[0] * 2.0 ** band) | (size > 0) & (step == 0)
        of = inside[doc]
        d, h = doc[of], code[of]
        if not len(d):
            continue
        bits = band[d].astype(np.uint64)
        block = np.where(bits > 0, h >> (np.uint64(64) - np.maximum(bits, np.uint64(1))), np.uint64(0))
        new = np.ones(len(d), dtype=bool)
        new[1:] = (d[1:] != d[:-1]) | (block[1:] != block[:-1])
        at = np.flatnonzero(new)
        with np.errstate(over="ignore"):
            parity = np.bitwise_xor.reduceat(words.mix(h + np.uint64(29)), at)
            key = words.mix(parity + words.mix(block[at] * _MULTIPLIERS[1] + bits[at] * _MULTIPLIERS[2]))
        kd = d[at]
        # the largest distance to a partner that the band takes
        partner = np.minimum(size * den // num, np.floor(FILL[1] * 2.0 ** band).astype(np.int64))
        most = (den - num) * (size + np.maximum(partner, size)) // (den + num)
        filled = np.bincount(kd, minlength=len(size))
        shown = _leading(kd, key, late(key), most)
        out_doc.append(kd[shown])
        out_key.append(key[shown])
        # sets that crowd into too few blocks also show single n-grams, which finds pairs of such sets
        weak = (inside & (filled <= most))[d]
        if weak.any():
            with np.errstate(over="ignore"):
                wd, wk = d[weak], words.mix(h[weak] + np.uint64(31))
            shown = _leading(wd, wk, late(wk), size + (-num * size) // den)
            out_doc.append(wd[shown])
            out_key.append(wk[shown])
    if not out_doc:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    return np.concatenate(out_doc), np.concatenate(out_key)


def sketch(code: np.ndarray) -> bytes:
    """Parity bits of a set, about one per member, indexed by the hashes' top bits."""
    bits = max(6, int(len(code)).bit_length())
    flips = np.bincount((code >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits) & 1
    return np.packbits(flips.astype(np.uint8)).tobytes()


def sketch_distance(a: bytes, b: bytes) -> int:
    """Hamming distance of two sketches, the longer folded to the shorter: never more than the symmetric difference."""
    x, y = (np.unpackbits(np.frombuffer(s, dtype=np.uint8)) for s in (a, b))
    while len(x) != len(y):
        if len(x) < len(y):
            x, y = y, x
        x = x[::2] ^ x[1::2]
    return int(np.count_nonzero(x != y))


def sketch_distances(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """``sketch_distance`` of each pair, for pairs of the same lengths at once."""
    x, y = np.array([len(z) for z in a], dtype=np.int64), np.array([len(z) for z in b], dtype=np.int64)
    apart = np.zeros(len(a), dtype=np.int64)
    for n, m in set(zip(x.tolist(), y.tolist())):
        at = np.flatnonzero((x == n) & (y == m))
        u, v = (np.frombuffer(b"".join(z[i] for i in at), np.uint8).reshape(len(at), -1) for z in (a, b))
        while u.shape[1] != v.shape[1]:
            u, v = (_folded(u), v) if u.shape[1] > v.shape[1] else (u, _folded(v))
        apart[at] = np.bitwise_count(u ^ v).sum(axis=1, dtype=np.int64)
    return apart


def _folded(bits: np.ndarray) -> np.ndarray:
    """Rows of packed sketches at half their length."""
    wide = np.unpackbits(bits, axis=1)
    return np.packbits(wide[:, ::2] ^ wide[:, 1::2], axis=1)


class _Sketches:
    """Nodes with their sketches, by the sketches' length in bytes (a power of two, 8 at least)."""

    def __init__(self, node: np.ndarray, size: np.ndarray, comp: np.ndarray, sketches: list[bytes],
                 out: np.ndarray | None = None, earlier: pa.ChunkedArray | None = None):
        self.node, self.size, self.comp = node, size.astype(np.int64), comp
        length = np.array([len(x) for x in sketches])
        self.out, self.earlier = out, earlier
        self.by_length = {int(n): (at := np.flatnonzero(length == n), np.frombuffer(b"".join(sketches[i] for i in at), np.uint8).reshape(-1, n)) for n in np.unique(length)}

    @classmethod
    def of(cls, rows: list[pa.RecordBatch]) -> _Sketches:
        """Nodes of batches as in ``_BLOCK``."""
        node, size, comp, out = (np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in rows]) for i in (3, 4, 5, 6))
        return cls(node, size, comp, [x for b in rows for x in b.column(7).to_pylist()], out, pa.chunked_array([b.column(8) for b in rows]))

    def elsewhere(self, at: np.ndarray) -> list[set[int]]:
        """The earlier buckets of the nodes at these places."""
        which, back = np.unique(at, return_inverse=True)
        sets = [set(x) for x in self.earlier.take(pa.array(which)).to_pylist()]
        return [sets[i] for i in back.tolist()]

    def meet(self, other: _Sketches, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
        """``near`` by distance, without the pairs of two outside nodes that meet the other way round as well
        and those that both know to meet in an earlier bucket."""
        a, o, apart = self.near(other, num, den)
        once = ~other.out[o] | (self.node[a] < other.node[o])
        a, o, apart = a[once], o[once], apart[once]
        if len(a):
            first = np.array([x.isdisjoint(y) for x, y in zip(self.elsewhere(a), other.elsewhere(o))])
            a, o, apart = a[first], o[first], apart[first]
        order = np.argsort(apart, kind="stable")
        return a[order], o[order]

    def near(self, other: _Sketches, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs (place here, place in ``other``) of different components whose sketches are near enough, and their distances."""
        out = []
        for n, (i, x) in self.by_length.items():
            for m, (j, y) in other.by_length.items():
                s, t = self.size[i][:, None], other.size[j][None, :]
                fits = (den * np.minimum(s, t) >= num * np.maximum(s, t)) & (self.comp[i][:, None] != other.comp[j][None, :])
                at, to = np.nonzero(fits)
                if not len(at):
                    continue
                u, v = x, y
                while u.shape[1] != v.shape[1]:
                    u, v = (_folded(u), v) if u.shape[1] > v.shape[1] else (u, _folded(v))
                u, v = (np.ascontiguousarray(z).view(np.uint64 if z.shape[1] % 8 == 0 else np.uint8) for z in (u, v))
                apart = np.zeros(len(at), dtype=np.int64)
                for w in range(u.shape[1]):
                    apart += np.bitwise_count(u[at, w] ^ v[to, w])
                keep = apart * (den + num) <= (den - num) * (self.size[i][at] + other.size[j][to])
                out.append((i[at[keep]], j[to[keep]], apart[keep]))
        if not out:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(z) for z in zip(*out))


_BLOCK = "key bigint, chunk int, role int, node bigint, size bigint, comp bigint, out boolean, sketch binary, earlier array<bigint>"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, int, pa.RecordBatch]]:
    """Runs of rows of one block (``key, chunk``) and role: whether a block begins, the role, the rows."""
    now = None
    for b in batches:
        key, chunk, role = (b.column(i).to_numpy() for i in range(3))
        edge = np.flatnonzero((key[1:] != key[:-1]) | (chunk[1:] != chunk[:-1]) | (role[1:] != role[:-1])) + 1
        for at, end in zip([0, *edge.tolist()], [*edge.tolist(), b.num_rows]):
            if at < end:
                yield (key[at], chunk[at]) != now, int(role[at]), b.slice(at, end - at)
                now = key[at], chunk[at]


def _fresh(digest: np.ndarray, size: np.ndarray, seen: set[int]) -> np.ndarray:
    """Whether a node with n-grams is not among ``seen``, which gains it as long as it has fewer than ``SEEN``."""
    fresh = np.zeros(len(digest), dtype=bool)
    for i, x in enumerate(digest.tolist()):
        if size[i] and x not in seen:
            fresh[i] = True
            if len(seen) < SEEN:
                seen.add(x)
    return fresh


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


class _Join:
    def __init__(self, docs: DataFrame, id_col: str, text_col: str, n: int, num: int, den: int, extra: list[str]):
        self.rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *[F.col(c).alias(f"x{i}") for i, c in enumerate(extra)])
        self.kind = self.rows.schema["id"].dataType.simpleString()
        self.n, self.num, self.den = n, num, den
        self.repeats = False  # whether some id and text come in several rows
        self.sent: list[Broadcast] = []  # what the tasks that give keys need

    def nodes(self) -> tuple[DataFrame, DataFrame]:
        """``id, node, size`` of every row; ``key, n`` of the keys that come more than once within ``WINDOW_SLICES`` slices."""
        n, num, den = self.n, self.num, self.den
        none = np.zeros(0, dtype=np.uint64)
        extra = [f for f in self.rows.schema.fields if f.name not in ("id", "text")]

        def repeated(held: list[np.ndarray], schema: pa.Schema) -> pa.RecordBatch:
            key, times = np.unique(np.concatenate(held), return_counts=True)
            key, times = key[times > 1], times[times > 1]
            return pa.RecordBatch.from_arrays([*(pa.nulls(len(key), t) for t in schema.types[:-2]), _signed(key), pa.array(times)], schema=schema)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set[int] = set()
            held: list[np.ndarray] = []
            schema = None
            for b in slices(batches, 1):
                doc, code = ngram_sets(*text_buffer(b.column(1)), n)
                digest, size = nodes_of(doc, code, b.num_rows)
                out = pa.RecordBatch.from_arrays([b.column(0), _signed(digest), pa.array(size), *b.columns[2:], pa.nulls(b.num_rows, pa.int64()), pa.nulls(b.num_rows, pa.int64())],
                                                 ["id", "node", "size", *b.schema.names[2:], "key", "n"])
                schema = out.schema
                yield out
                held.append(block_keys(doc, code, np.where(_fresh(digest, size, seen), size, 0), none, num, den)[1])
                if len(held) == WINDOW_SLICES:
                    yield repeated(held, schema)
                    held = []
            if held:
                yield repeated(held, schema)

        types = f"id {self.kind}, node bigint, size bigint" + "".join(f", {f.name} {f.dataType.simpleString()}" for f in extra) + ", key bigint, n bigint"
        found = stored(in_arrow(self.rows, run, types), "join-rows")
        return found.filter("n IS NULL").drop("key", "n"), found.filter("n IS NOT NULL").select("key", "n")

    def _keys(self, hot: np.ndarray, sieve: np.ndarray | None) -> DataFrame:
        """``key`` of the nodes, each node once in a task; with a sieve ``key, node, size`` of the keys that pass it."""
        n, num, den = self.n, self.num, self.den
        late = self.rows.sparkSession.sparkContext.broadcast(hot)
        passed = None if sieve is None else self.rows.sparkSession.sparkContext.broadcast(sieve)
        self.sent += [late] if passed is None else [late, passed]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set[int] = set()
            for b in slices(batches, 0):
                doc, code = ngram_sets(*text_buffer(b.column(0)), n)
                digest, size = nodes_of(doc, code, b.num_rows)
                kd, key = block_keys(doc, code, np.where(_fresh(digest, size, seen), size, 0), late.value, num, den)
                if passed is None:
                    yield pa.RecordBatch.from_arrays([_signed(key)], ["key"])
                else:
                    bit = (key & np.uint64(SIEVE_BITS - 1)).astype(np.int64)
                    of = ((passed.value[bit >> 6] >> (bit & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)
                    yield pa.RecordBatch.from_arrays([_signed(key[of]), _signed(digest[kd[of]]), pa.array(size[kd[of]])], ["key", "node", "size"])

        return in_arrow(self.rows.select("text"), run, "key bigint" if sieve is None else "key bigint, node bigint, size bigint")

    def candidates(self, common: DataFrame) -> tuple[DataFrame, DataFrame]:
        """``key, node, size`` of buckets with more than ``HOT`` nodes, and all pairs ``a, b`` with the number of keys they share.

        A bucket of at most ``HOT`` nodes gives all its pairs, a larger one those with its smallest node.
        """
        often = (common.groupBy("key").agg(F.sum("n").alias("n")).filter(f"n > {HOT}")
                 .orderBy(F.desc("n"), "key").limit(MAX_LATE).toArrow())
        hot = np.sort(often["key"].to_numpy().view(np.uint64))
        bit = F.col("key").bitwiseAND(SIEVE_BITS - 1)
        shared = self._keys(hot, None).groupBy("key").count().filter("count > 1")
        bits = shared.groupBy(F.shiftright(bit, 6).alias("word")).agg(
            F.bit_or(F.expr("shiftleft(1L, cast(key & 63 as int))")).alias("bits"))  # at most SIEVE_BITS / 64 rows
        table = bits.toArrow()
        sieve = np.zeros(SIEVE_BITS // 64, dtype=np.uint64)
        sieve[table["word"].to_numpy()] = table["bits"].to_numpy().view(np.uint64)
        rows = self._keys(hot, sieve).repartition("key").sortWithinPartitions("key", "node")
        found = stored(in_arrow(rows, self._buckets(), "key bigint, a bigint, b bigint, n bigint"), "join-buckets")
        for x in self.sent:
            x.unpersist()
        pairs = found.filter("b IS NOT NULL").groupBy("a", "b").agg(F.sum("n").alias("n"))
        members = found.filter("b IS NULL").select("key", F.col("a").alias("node"), F.col("n").alias("size"))
        return members, stored(pairs, "join-pairs")

    def _buckets(self):
        """A task that reads rows sorted by key and node, and gives ``a, b`` and how many keys they share here, or
        ``key, a`` and its size for members of buckets with more than ``HOT`` nodes."""
        num, den = self.num, self.den

        def counted(parts: list[tuple[np.ndarray, ...]]) -> list[pa.Array]:
            a, b, sa, sb = (np.concatenate(x) for x in zip(*parts, strict=True))
            alike = den * np.minimum(sa, sb) >= num * np.maximum(sa, sb)
            a, b = a[alike], b[alike]
            order = np.lexsort((b, a))
            a, b = a[order], b[order]
            new = np.flatnonzero(np.concatenate([np.ones(min(1, len(a)), bool), (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
            return [pa.nulls(len(new), pa.int64()), pa.array(a[new]), pa.array(b[new]), pa.array(np.diff(np.append(new, len(a))))]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names = ["key", "a", "b", "n"]
            hot: tuple[int, int, int, int] | None = None  # a large bucket that goes on: key, smallest node and its size, last node
            held: list[np.ndarray] = []
            n_held = 0

            def large_ones(key: np.ndarray, node: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(key), pa.array(node), pa.nulls(len(key), pa.int64()), pa.array(size)], names)

            def work(rows: np.ndarray, last: bool) -> tuple[np.ndarray, list[pa.RecordBatch]]:
                nonlocal hot
                out, parts = [], []
                key, node, size = rows
                new = np.ones(len(key), dtype=bool)
                new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
                key, node, size = key[new], node[new], size[new]
                if hot is not None and len(key):  # rows of the bucket that was open
                    n = int(np.searchsorted(key, hot[0], side="right"))
                    at = np.flatnonzero(node[:n] != hot[3])
                    if len(at):
                        parts.append((np.full(len(at), hot[1]), node[at], np.full(len(at), hot[2]), size[at]))
                        out.append(large_ones(key[at], node[at], size[at]))
                        hot = (*hot[:3], int(node[at[-1]]))
                    if n < len(key):
                        hot = None
                    key, node, size = key[n:], node[n:], size[n:]
                first = np.flatnonzero(np.concatenate([np.ones(min(1, len(key)), bool), key[1:] != key[:-1]]))
                count = np.diff(np.append(first, len(key)))
                left = np.zeros((3, 0), dtype=np.int64)
                if len(first) and not last:
                    if count[-1] > HOT:  # the last bucket may go on
                        hot = (int(key[-1]), int(node[first[-1]]), int(size[first[-1]]), int(node[-1]))
                    else:
                        end = first[-1]
                        left = np.stack([key[end:], node[end:], size[end:]])
                        key, node, size, first, count = key[:end], node[:end], size[:end], first[:-1], count[:-1]
                of = np.repeat(count, count)
                for step in range(1, HOT):
                    i = np.flatnonzero((key[step:] == key[:-step]) & (of[step:] <= HOT)) if len(key) > step else np.zeros(0, np.int64)
                    if not len(i):
                        break
                    parts.append((node[i], node[i + step], size[i], size[i + step]))
                large = np.flatnonzero(of > HOT)
                if len(large):
                    lo = np.repeat(first, count)[large]
                    rest = lo != large
                    parts.append((node[lo[rest]], node[large[rest]], size[lo[rest]], size[large[rest]]))
                    out.append(large_ones(key[large], node[large], size[large]))
                if parts:
                    out.append(pa.RecordBatch.from_arrays(counted(parts), names))
                return left, out

            for b in batches:
                held.append(np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns]))
                n_held += b.num_rows
                if n_held >= GROUP_ROWS:
                    left, out = work(np.concatenate(held, axis=1), False)
                    yield from out
                    held, n_held = [left], 0
            if held:
                yield from work(np.concatenate(held, axis=1), True)[1]

        return run

    def open_buckets(self, members: DataFrame, labels: DataFrame) -> DataFrame:
        """Members of buckets in which components meet, with their component and the bucket's main one."""
        placed = members.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        split = placed.groupBy("key").agg(F.mode("comp").alias("main"), F.min("comp").alias("c0"), F.max("comp").alias("c1")).filter("c0 <> c1")
        return stored(placed.join(split.select("key", "main"), "key"), "join-open")

    def inside(self, open_: DataFrame, sketches: DataFrame) -> DataFrame:
        """Blocks of nodes ``role = 0`` outside their bucket's main component and members ``role = 1`` of the bucket, without the rows that have
        no partner of another component in their block whose sketch does not rule it out: ``key, chunk, role, node, size, comp, out, sketch, earlier``.

        Of buckets with the same members only one is searched.  Outside nodes are dealt into chunks by hash, past each of
        which the other members stream.
        """
        num, den = self.num, self.den
        hashed, outer = F.xxhash64("node"), F.col("comp") != F.col("main")
        same = open_.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.sum(hashed.bitwiseAND((1 << 40) - 1)).alias("h0"), F.expr("bit_xor(xxhash64(node))").alias("h1"),
                                        F.greatest(F.ceil(F.count_if(outer) / CHUNK), F.ceil(F.sum(F.when(outer, F.col("size"))) / HELD_GRAMS)).cast("int").alias("chunks"))
        one = same.groupBy("m", "h0", "h1").agg(F.min(F.struct("key", "chunks")).alias("k")).select("k.key", "k.chunks")
        rows = open_.join(one, "key")
        known = rows.groupBy("node").agg(F.slice(F.array_sort(F.collect_list("key")), 1, KNOWN_BUCKETS).alias("keys"))
        rows = (rows.join(known.join(sketches.select("node", "sketch"), "node"), "node")
                .withColumn("earlier", F.filter("keys", lambda k: k < F.col("key"))).drop("keys"))
        outside = rows.filter(outer).select("key", F.pmod(hashed, F.col("chunks")).cast("int").alias("chunk"), F.lit(0).alias("role"),
                                            "node", "size", "comp", F.lit(True).alias("out"), "sketch", "earlier")
        others = rows.select("key", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(1).alias("role"),
                             "node", "size", "comp", outer.alias("out"), "sketch", "earlier")
        both = outside.unionByName(others).repartition("key", "chunk").sortWithinPartitions("key", "chunk", "role", "node")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.RecordBatch] = []
            table: _Sketches | None = None
            met = np.zeros(0, dtype=bool)

            def partnered() -> pa.RecordBatch:
                return pa.Table.from_batches(held).filter(pa.array(met)).combine_chunks().to_batches()[0]

            for fresh, role, b in _blocks(batches):
                if fresh:
                    if met.any():
                        yield partnered()
                    held, table, met = [], None, np.zeros(0, dtype=bool)
                if role == 0:
                    held.append(b)
                    continue
                if not held:
                    continue
                if table is None:
                    table = _Sketches.of(held)
                    met = np.zeros(len(table.node), dtype=bool)
                with_partner = np.zeros(b.num_rows, dtype=bool)
                for c in range(0, b.num_rows, PASSING):
                    a, o = table.meet(_Sketches.of([b.slice(c, PASSING)]), num, den)
                    met[a] = True
                    with_partner[c + o] = True
                if with_partner.any():
                    yield b.filter(pa.array(with_partner))
            if met.any():
                yield partnered()

        return in_arrow(both, run, _BLOCK)

    def joined(self, blocks: DataFrame, sets: DataFrame) -> DataFrame:
        """Links ``a, b`` by their whole sets that join all members of a block which its links connect, each of them
        between components that the block's earlier links leave apart."""
        num, den = self.num, self.den
        rows = blocks.join(sets.select("node", "grams"), "node").select(*blocks.columns, "grams")
        rows = rows.repartition("key", "chunk").sortWithinPartitions("key", "chunk", "role", "node")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.RecordBatch] = []
            table: _Sketches | None = None
            grams: list[np.ndarray] = []
            up: dict[int, int] = {}

            def root(x: int) -> int:
                while (y := up.get(x, x)) != x:
                    up[x] = up.get(y, y)
                    x = y
                return x

            for fresh, role, b in _blocks(batches):
                if fresh:
                    held, table, grams, up = [], None, [], {}
                if role == 0:
                    held.append(b)
                    continue
                if not held:
                    continue
                if table is None:
                    table = _Sketches.of(held)
                    grams = [_hashes(x) for h in held for x in h.column(9)]
                links = []
                for c in range(0, b.num_rows, PASSING):
                    part = b.slice(c, PASSING)
                    passing = _Sketches.of([part])
                    theirs: dict[int, np.ndarray] = {}
                    for i, j in zip(*(x.tolist() for x in table.meet(passing, num, den))):
                        p, q = root(int(table.comp[i])), root(int(passing.comp[j]))
                        if p == q:
                            continue
                        if j not in theirs:
                            theirs[j] = _hashes(part.column(9)[j])
                        if _alike(grams[i], theirs[j], num, den):
                            up[max(p, q)] = min(p, q)
                            links.append((int(table.node[i]), int(passing.node[j])))
                if links:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links)], ["a", "b"])

        return in_arrow(rows, run, "a bigint, b bigint").distinct()

    def grams(self, wanted: DataFrame, whole: bool) -> DataFrame:
        """``node`` and its set (``whole``; 48 bits of each hash) or ``size, sketch``, from one document (``id``) of each wanted node."""
        n = self.n

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches, 0):
                doc, code = ngram_sets(*text_buffer(b.column(0)), n)
                digest, size = nodes_of(doc, code, b.num_rows)
                cut = np.concatenate([[0], np.cumsum(size)])
                parts = [code[cut[i]:cut[i + 1]] for i in range(b.num_rows)]
                if whole:
                    sets = [np.ascontiguousarray(p.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:]).tobytes() for p in parts]
                    yield pa.RecordBatch.from_arrays([_signed(digest), pa.array(sets, pa.binary())], ["node", "grams"])
                else:
                    yield pa.RecordBatch.from_arrays([_signed(digest), pa.array(size), pa.array([sketch(p) for p in parts], pa.binary())], ["node", "size", "sketch"])

        ids = broadcast_if_small(wanted.select(F.col("id").alias("wanted")).distinct())
        texts = self.rows.join(ids, self.rows["id"].eqNullSafe(ids["wanted"]), "left_semi").select("text")
        found = in_arrow(texts, run, "node bigint, grams binary" if whole else "node bigint, size bigint, sketch binary")
        return found.dropDuplicates(["node"]) if self.repeats else found

    def near(self, pairs: DataFrame, sketches: DataFrame) -> DataFrame:
        """Pairs ``a, b, n`` that their sketches do not rule out."""
        num, den = self.num, self.den

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                apart = sketch_distances(b.column(3).to_pylist(), b.column(4).to_pylist())
                keep = apart * (den + num) <= (den - num) * (b.column(5).to_numpy() + b.column(6).to_numpy())
                yield b.select([0, 1, 2]).filter(pa.array(keep))

        a = sketches.select(F.col("node").alias("a"), F.col("sketch").alias("xa"), F.col("size").alias("sa"))
        b = sketches.select(F.col("node").alias("b"), F.col("sketch").alias("xb"), F.col("size").alias("sb"))
        both = pairs.join(a, "a").join(b, "b").select("a", "b", "n", "xa", "xb", "sa", "sb")
        return in_arrow(both, run, "a bigint, b bigint, n bigint")

    def links(self, pairs: DataFrame, known: DataFrame) -> DataFrame:
        """Pairs that are similar, by their whole sets; only the sets of these pairs are built and moved."""
        num, den = self.num, self.den
        pairs = stored(pairs, "join-checks")
        small = broadcast_if_small(pairs)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keep = [_alike(_hashes(x), _hashes(y), num, den) for x, y in zip(b.column(2), b.column(3), strict=True)]
                yield b.filter(pa.array(keep, pa.bool_())).select([0, 1])

        def side(end: str, name: str) -> DataFrame:
            wanted = known.join(pairs.select(F.col(end).alias("node")).distinct(), "node", "left_semi")
            return self.grams(wanted, True).withColumnRenamed("node", end).join(small, end).select("a", "b", F.col("grams").alias(name))

        return in_arrow(side("a", "xa").join(side("b", "xb"), ["a", "b"]).select("a", "b", "xa", "xb"), run, "a bigint, b bigint")


def _hashes(grams: pa.BinaryScalar) -> np.ndarray:
    """A set as ``grams`` gives it, as sorted numbers."""
    x = np.frombuffer(grams.as_buffer(), dtype=np.uint8).reshape(-1, 6)
    out = np.zeros((len(x), 8), dtype=np.uint8)
    out[:, :6] = x
    return out.view("<u8").ravel()


def _alike(u: np.ndarray, v: np.ndarray, num: int, den: int) -> bool:
    both = len(np.intersect1d(u, v))
    return den * both >= num * (len(u) + len(v) - both)


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs whose ends are not known to be connected."""
    a = labels.select(F.col("node").alias("a"), F.col("comp").alias("ca"))
    b = labels.select(F.col("node").alias("b"), F.col("comp").alias("cb"))
    return (pairs.join(a, "a", "left").join(b, "b", "left")
            .filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).drop("ca", "cb"))


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = NGRAM,
                       num: int = NUM, den: int = DEN, extra: list[str] | None = None) -> DataFrame:
    """``id_col, n_shingles, component_id`` and the columns ``extra``, one row per input row.

    Two documents are linked if ``den * |intersection| >= num * |union|`` of their sets of word n-grams
    (``n`` words; with fewer words the whole sequence; without words none), and
    ``component_id`` is the smallest id that links reach.  Null and empty texts are linked with
    nothing and are their own component; equal texts are linked; rows with a null id link
    others, and have a null component only if no row they reach has an id; a repeated row
    is in its copies' component; an empty table gives an empty result; other columns are ignored.
    """
    job = _Join(docs, id_col, text_col, n, num, den, extra or [])
    rows, common = job.nodes()
    job.repeats = not rows.groupBy("id", "node").count().filter("count > 1").isEmpty()
    spots = rows.filter("size > 0").groupBy("node").agg(F.min("id").alias("id"), F.first("size").alias("size"))
    members, pairs = job.candidates(common)
    known = stored(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(spots, "node"), "join-nodes")
    sketches = stored(job.grams(known, False), "join-sketches")
    pairs = stored(job.near(pairs, sketches), "join-near")

    # each node against the one it shares most keys with; then what is left between components
    best = pairs.groupBy("b").agg(F.max(F.struct("n", "a")).alias("m")).select(F.col("m.a").alias("a"), "b")
    edges = stored(job.links(best, known), "join-edges")
    labels = stored(components(edges), "join-labels")
    more = stored(job.links(_apart(pairs, labels).select("a", "b"), known), "join-edges")
    if not more.isEmpty():
        edges = edges.unionByName(more)
        labels = stored(components(edges), "join-labels")
    open_ = job.open_buckets(members, labels)
    if not open_.isEmpty():
        lone = stored(open_.select("node").distinct().join(known, "node", "left_anti").join(spots, "node"), "join-nodes")  # without any pair so far
        if not lone.isEmpty():
            sketches = sketches.unionByName(stored(job.grams(lone, False), "join-sketches"))
            known = known.unionByName(lone)
        blocks = stored(job.inside(open_, sketches), "join-blocks")
        sets = job.grams(known.join(blocks.select("node").distinct(), "node", "left_semi"), True)
        more = stored(job.joined(blocks, sets), "join-edges")
        if not more.isEmpty():
            labels = stored(components(edges.unionByName(more)), "join-labels")
    smallest = stored(spots.join(labels, "node").groupBy("comp").agg(F.min("id").alias("least")), "join-smallest")
    placed = labels.join(smallest, "comp").select("node", "least")
    alone = spots.select("node", F.col("id").alias("own"))
    whole = stored(alone.join(placed, "node", "left").select("node", F.coalesce("least", "own").alias("component")), "join-components")
    return rows.join(whole, "node", "left").select(
        F.col("id").alias(id_col), F.col("size").alias("n_shingles"),
        F.when(F.col("size") == 0, F.col("id")).otherwise(F.col("component")).alias("component_id"),
        *[F.col(f"x{i}").alias(c) for i, c in enumerate(extra or [])])


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component, that of the smallest id; all columns kept, whatever their names.

    Documents without words are all kept.  A row goes if its id is not its component's, so of rows that share an id
    only those in a component with a smaller id go, and every row that repeats the kept id and text stays.  A row with a null id
    goes if its component has an id, and stays otherwise.
    """
    job_rows = docs.select(F.col(id_col).alias("id"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("text_digest"), F.col(text_col).alias("text"))
    found = similar_components(job_rows, "id", "text", extra=["text_digest"])
    gone = found.filter((F.col("n_shingles") > 0) & F.col("component_id").isNotNull() & ~F.col("id").eqNullSafe(F.col("component_id")))
    gone = stored(gone.select("id", "text_digest").distinct(), "similar")
    names = docs.columns
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    key = F.sha2(F.coalesce(F.col(f"row.`{text_col}`"), F.lit("")), 256)
    kept = whole.join(broadcast_if_small(gone), F.col(f"row.`{id_col}`").eqNullSafe(F.col("id")) & (key == F.col("text_digest")), "left_anti")
    return kept.select("row.*")
