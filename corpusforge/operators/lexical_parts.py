"""EM and scoring of the lexical model over packed sentence pairs, parted by target type.

For a fixed target type f the E-step of IBM Model 1 needs only the column ``t(f|.)`` and the pairs that hold f:
``Z`` of a pair and f sums over the pair's source types, and the expected counts ``c(., f)`` sum over those pairs.
Only the totals ``ct(e) = sum_f c(e, f)`` couple the columns.  So pairs are packed once into *parts* by the hash of f: a
part has, for each of its pairs, the source types with their counts and the pair's targets of that part, in blocks of some hundred pairs that
name each type once.  A step is one pass
over the parts with one small shuffle, the sum of the totals by source type; there is no table of cells, and
neither cells nor probabilities are exchanged.  A task has no state: it replays the earlier steps of
its part from the totals of each step, which it gets as a broadcast, so a lost task is simply run again.

Source types are numbers in the blocks, whose arrays are compressed; their names go to the tasks once.  A target type with more than ``SPREAD``
parts' worth of cells (an end mark in very many pairs) is spread over several parts by the hash of the pair; its partial counts are summed in the same
shuffle as the totals and come back with them.

Pairs are scored in the same parts: their blocks meet the training blocks there, and a task finds the probabilities again and scores.  So the
table, which has nearly as many rows as there are cells, is only made when it is asked for.  A table that did not come from parts is sent to parts
of its own together with the packed pairs, in one shuffle; a task reads a part's table first and then streams the pairs.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from corpusforge.functions.text import EOS, SOS
from corpusforge.operators.joins import fits_arrays
from corpusforge.operators.lookup import Entries
from corpusforge.session import map_arrow, materialize

# Cells (source type, target type of a pair) of a part, about; a task holds one part at a time.
CELLS_PER_PART = 2_000_000
# A target type is spread if its cells are worth more than so many parts.
SPREAD = 4
# Cells that are scored in one step of arrays; table entries that a task turns into lists at a time.
CELLS_AT_ONCE, ENTRIES_AT_ONCE = 500_000, 200_000
_PACKED = "part int, src array<string>, ce array<int>, len int, trg array<string>, cf array<int>"
# The pairs of a batch that fall into a part: target types by name, and numbers (``_numbers``), in which types go by their places.
_BLOCK = "part int, f array<string>, pairs int, size int, data binary"
_BLOCK_NAMES = [x.split()[0] for x in _BLOCK.split(", ")]


@dataclass
class Layout:
    """Number of parts, over how many each very frequent target type is spread, and the number of target types."""

    parts: int
    salts: dict[str, int]
    targets: int = 0

    def part_of(self, f: str, salt: int = 0) -> int:
        return zlib.crc32(f"{salt}:{f}".encode()) % self.parts


def layout(pairs: DataFrame, src_col: str, trg_col: str, cells_per_part: int = CELLS_PER_PART) -> Layout:
    """Parts of about ``cells_per_part`` cells; fewer target types are spread than there are parts."""
    n_src = F.size(F.array_distinct(F.col(src_col))) + 2
    per = (pairs.select(n_src.cast("long").alias("n"), F.explode(F.array_distinct(F.concat(F.col(trg_col), F.array(F.lit(EOS))))).alias("f"))
           .groupBy("f").agg(F.sum("n").alias("n")))
    per = materialize(per)
    total, targets = per.agg(F.sum("n"), F.count(F.lit(1))).first()
    total = total or 0
    most = SPREAD * cells_per_part
    hot = {r["f"]: -(-r["n"] // most) for r in per.filter(F.col("n") > most).collect()}
    least = min(pairs.sparkSession.sparkContext.defaultParallelism, -(-total // 10_000))
    return Layout(max(1, least, -(-total // cells_per_part)), hot, targets)


def _collapsed(src: list[str] | None, trg: list[str] | None) -> tuple[dict[str, int], int, dict[str, int]]:
    """Source types with counts (the begin mark is the null word), source length, target types with counts."""
    s = [SOS, *(x for x in src or () if x is not None), EOS]
    return Counter(s), len(s), Counter([*(x for x in trg or () if x is not None), EOS])


def _packer(lay: Layout, n_keys: int):
    """Rows of a pair, one for each part that one of its targets falls into."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, out, row_of = b.columns[:n_keys], [], []
            salted = b.column(n_keys).to_pylist()
            for i, (src, trg) in enumerate(zip(b.column(n_keys + 1).to_pylist(), b.column(n_keys + 2).to_pylist(), strict=True)):
                s, length, t = _collapsed(src, trg)
                by_part: dict[int, dict[str, int]] = {}
                for f, n in t.items():
                    by_part.setdefault(lay.part_of(f, salted[i] % lay.salts[f] if f in lay.salts else 0), {})[f] = n
                for part, fs in by_part.items():
                    out.append((part, list(s), list(s.values()), length, list(fs), list(fs.values())))
                    row_of.append(i)
            kinds = (pa.int32(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.int32(), pa.list_(pa.string()), pa.list_(pa.int32()))
            cols = list(zip(*out)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [*(k.take(pa.array(row_of, pa.int64())) for k in keys), *(pa.array(list(c), t) for c, t in zip(cols, kinds))],
                [*b.schema.names[:n_keys], "part", "src", "ce", "len", "trg", "cf"])
    return run


def packed(pairs: DataFrame, key_cols: list[str], src_col: str, trg_col: str, lay: Layout, with_keys: bool) -> DataFrame:
    """``pairs`` as rows of parts; with their key columns (as ``k0``, ``k1``, ...) if they are scored."""
    salt = F.pmod(F.xxhash64(*key_cols), F.lit(1 << 30)).cast("long")
    keys = [F.col(k).alias(f"k{i}") for i, k in enumerate(key_cols)] if with_keys else []
    rows = pairs.select(*keys, salt.alias("salt"), F.col(src_col).alias("src"), F.col(trg_col).alias("trg"))
    schema = StructType([*rows.schema.fields[:len(keys)], *StructType.fromDDL(_PACKED).fields])
    return map_arrow(rows, _packer(lay, len(keys)), schema)


def _types(column: pa.Array, ends: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Row, code and count of the types of each list with ``ends`` added to each, ordered by row, and the types by code; nulls are left out."""
    rows = len(column)
    flat = column.flatten()
    there = np.asarray(flat.is_valid())
    row = np.repeat(np.arange(rows), pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))[there]
    coded = pa.concat_arrays([flat.filter(pa.array(there, pa.bool_())), pa.array(ends, flat.type)]).dictionary_encode()
    code = coded.indices.to_numpy().astype(np.int64)
    own, added = code[:len(row)], code[len(row):]
    both, times = np.unique(np.concatenate([row << 32 | own, (np.arange(rows)[:, None] << 32 | added).ravel()]), return_counts=True)
    return both >> 32, both & 0xFFFFFFFF, times, coded.dictionary


def _blocked(lay: Layout, types, n_keys: int = 0):
    """The pairs of an Arrow batch as one row for each part that some of their targets fall into, with the pairs' keys as lists.

    ``types`` is the broadcast of the source types; a type that is not among them has no probability and only counts in the length.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = types.value
        for b in batches:
            if not b.num_rows:
                continue
            salt = b.column(n_keys).to_numpy()
            s_row, s_code, s_times, es = _types(b.column(n_keys + 1), [SOS, EOS])
            length = np.bincount(s_row, weights=s_times, minlength=b.num_rows).astype(np.int64)
            s_code = known.find(es)[s_code]
            order = np.lexsort((s_code, s_row))
            order = order[s_code[order] >= 0]
            s_row, s_code, s_times = s_row[order], s_code[order], s_times[order]
            row, code, times, fs = _types(b.column(n_keys + 2), [EOS])
            part = np.array([lay.part_of(f) for f in fs.to_pylist()])[code]
            for j, f in enumerate(fs.to_pylist()):
                if f in lay.salts:
                    at = np.flatnonzero(code == j)
                    part[at] = np.array([lay.part_of(f, i) for i in range(lay.salts[f])])[salt[row[at]] % lay.salts[f]]
            order = np.lexsort((row, part))
            part, row, code, times = part[order], row[order], code[order], times[order]
            n_src = np.bincount(s_row, minlength=b.num_rows)
            s_begin = np.cumsum(n_src) - n_src
            out, keys = [], []
            ends = np.append(np.flatnonzero(np.diff(part)) + 1, len(part))
            for lo, hi in zip([0, *ends[:-1].tolist()], ends.tolist()):
                pairs, n_trg = np.unique(row[lo:hi], return_counts=True)
                at = _spans(s_begin[pairs], n_src[pairs])
                f, f_at = np.unique(code[lo:hi], return_inverse=True)
                size, data = _compressed((n_src[pairs], length[pairs], n_trg, s_code[at], s_times[at], f_at, times[lo:hi]))
                out.append((int(part[lo]), fs.take(pa.array(f)).to_pylist(), len(pairs), size, data))
                keys.append(pairs)
            kinds = (pa.int32(), pa.list_(pa.string()), pa.int32(), pa.int32(), pa.binary())
            offsets = pa.array(np.cumsum([0, *map(len, keys)]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, k.take(pa.array(np.concatenate(keys)))) for k in b.columns[:n_keys]]
            yield pa.RecordBatch.from_arrays([*(pa.array(list(c), t) for c, t in zip(zip(*out), kinds)), *lists], [*_BLOCK_NAMES, *b.schema.names[:n_keys]])
    return run


def _compressed(arrays) -> tuple[int, bytes]:
    """32-bit numbers, all first bytes before all second ones; their bytes before compression, and the compressed ones."""
    flat = np.concatenate(arrays).astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes()
    return len(flat), pa.compress(flat, codec="zstd", asbytes=True)


@dataclass
class Block:
    """The pairs of a block: source types, length and targets of each, then the types with their counts in each pair."""

    f: pa.Array
    n_src: np.ndarray
    length: np.ndarray
    n_trg: np.ndarray
    e: np.ndarray
    ce: np.ndarray
    f_at: np.ndarray
    cf: np.ndarray


def _block(f: pa.Array, pairs: int, size: int, data: bytes) -> Block:
    flat = np.frombuffer(pa.decompress(data, decompressed_size=size, codec="zstd"), np.uint8).reshape(4, -1).T.copy().view("<i4").ravel().astype(np.int64)
    n_src, length, n_trg, rest = flat[:pairs], flat[pairs:2 * pairs], flat[2 * pairs:3 * pairs], flat[3 * pairs:]
    n, m = int(n_src.sum()), int(n_trg.sum())
    return Block(f, n_src, length, n_trg, rest[:n], rest[n:2 * n], rest[2 * n:2 * n + m], rest[2 * n + m:])


def _read(b: pa.RecordBatch, i: int) -> Block:
    return _block(b.column(1)[i].values, *(b.column(c)[i].as_py() for c in (2, 3, 4)))


def _spans(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``begin[i], begin[i] + 1, ...`` of ``size[i]`` places, for each i."""
    return np.arange(int(size.sum())) + np.repeat(begin - (np.cumsum(size) - size), size)


class Part:
    """The cells of a part as flat arrays, a segment for each pair and target; source types go by their numbers."""

    def __init__(self, blocks: list[Block]):
        self.f, f_of, f_first = _joined([b.f for b in blocks])
        n_src, n_trg, e, ce, cf = (np.concatenate([getattr(b, c) for b in blocks]) for c in ("n_src", "n_trg", "e", "ce", "cf"))
        f = f_of[np.concatenate([b.f_at + at for b, at in zip(blocks, f_first)])]
        self.size = np.repeat(n_src, n_trg)
        at = _spans(np.repeat(np.cumsum(n_src) - n_src, n_trg), self.size)
        self.weight = ce[at].astype(np.float64)
        cells = e[at]
        del at
        cells |= np.repeat(f << 32, self.size)
        self.codes, cell = np.unique(cells, return_inverse=True)
        self.cell = cell.astype(np.int32)
        self.cell_e, self.cell_f = self.codes & 0xFFFFFFFF, self.codes >> 32
        self.first = np.cumsum(self.size) - self.size
        self.times = cf.astype(np.float64)

    def expected(self, t: np.ndarray | None) -> np.ndarray:
        """Expected counts of the part's cells under ``t`` (None: uniform)."""
        w = self.weight if t is None else self.weight * t[self.cell]
        z = np.add.reduceat(w, self.first)
        share = np.divide(self.times, z, out=np.zeros_like(z), where=z > 0)
        return np.bincount(self.cell, weights=w * np.repeat(share, self.size), minlength=len(self.cell_e))

    def probabilities(self, history: list[Sums], prune_below: float) -> np.ndarray | None:
        """``t`` after the steps of ``history``."""
        t = None
        for sums in history:
            c = self.expected(t)
            for j, f in enumerate(self.f.to_pylist()):
                if f in sums.spread:
                    here = np.flatnonzero(self.cell_f == j)
                    e, x = sums.spread[f]
                    c[here] = x[np.searchsorted(e, self.cell_e[here])]
            t = c / sums.totals[self.cell_e]
            if prune_below > 0:
                t[t < prune_below] = 0.0
        return t

    def leading(self, t: np.ndarray, allowed: np.ndarray, within: float) -> np.ndarray:
        """Of the ``allowed`` cells those that ``within`` may be the largest ``t`` of their source type in this part; of equal ones the smallest target."""
        at = np.flatnonzero(allowed)
        at = at[np.argsort(self.cell_e[at], kind="stable")]
        if not len(at):
            return at
        first = np.flatnonzero(np.diff(self.cell_e[at], prepend=-1))
        top = np.repeat(np.maximum.reduceat(t[at], first), np.diff(np.append(first, len(at))))
        at = at[t[at] >= top - within]
        place = np.empty(len(self.f), dtype=np.int64)
        place[pc.sort_indices(self.f).to_numpy()] = np.arange(len(self.f))
        at = at[np.lexsort((place[self.cell_f[at]], t[at], self.cell_e[at]))]
        return at[(np.diff(self.cell_e[at], prepend=-1) != 0) | (np.diff(t[at], prepend=-1.0) != 0)]


def _joined(names: list[pa.Array]) -> tuple[pa.Array, np.ndarray, list[int]]:
    """The distinct strings of some arrays, the place among them of each string of all, and where each array begins in that."""
    coded = pa.concat_arrays(names).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64), np.concatenate([[0], np.cumsum([len(x) for x in names])[:-1]]).tolist()


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[Part]:
    """The parts of a partition whose rows are sorted by part."""
    now, blocks = None, []
    for b in batches:
        for i, part in enumerate(b.column(0).to_pylist()):
            if part != now and blocks:
                yield Part(blocks)
                blocks = []
            now = part
            blocks.append(_read(b, i))
    if blocks:
        yield Part(blocks)


@dataclass
class Sums:
    """Sums of a step: the totals by number of the source type, and the counts of each spread target type with their source types in order."""

    totals: np.ndarray
    spread: dict[str, tuple[np.ndarray, np.ndarray]]


@dataclass
class Training:
    """Packed training pairs and the steps made so far."""

    rows: DataFrame | None   # None: the source types are too many to go to every task
    lay: Layout
    prune_below: float
    history: list            # the sums of each step
    types: object = None     # broadcast of the source types
    spread: DataFrame | None = None  # e, f, t of the spread types after the last step

    @property
    def _given(self):
        return self.rows.sparkSession.sparkContext.broadcast(self.history)

    def now(self) -> Training:
        """The training as it stands, whatever steps follow."""
        return replace(self, history=list(self.history))

    def step(self) -> bool:
        """One EM step; False (and nothing done) if source types, totals and spread cells are too large to go to every task."""
        if self.rows is None:
            return False
        given, prune, salts = self._given, self.prune_below, self.lay.salts

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for p in _parts(batches):
                c = p.expected(p.probabilities(given.value, prune))
                for j, f in enumerate(p.f.to_pylist()):
                    if f in salts:
                        here = np.flatnonzero(p.cell_f == j)
                        yield pa.RecordBatch.from_arrays([pa.array(p.cell_e[here], pa.int32()), pa.array([f] * len(here), pa.string()), pa.array(c[here])], ["e", "f", "x"])
                e, at = np.unique(p.cell_e, return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(e, pa.int32()), pa.nulls(len(e), pa.string()), pa.array(np.bincount(at, weights=c))], ["e", "f", "x"])

        sums = materialize(map_arrow(self.rows, run, "e int, f string, x double").groupBy("e", "f").agg(F.sum("x").alias("x")))
        if not fits_arrays(sums):
            return False
        got = sums.sort("e").toArrow().combine_chunks()
        f = got["f"].combine_chunks()
        rows = {name: got.filter(pc.equal(f, name)) for name in pc.unique(f).to_pylist() if name is not None}
        flat = {name: (_flat(t["e"]).to_numpy().astype(np.int64), _flat(t["x"]).to_numpy()) for name, t in rows.items()}
        own = got.filter(pc.is_null(f))
        totals = np.zeros(len(self.types.value.keys))
        totals[_flat(own["e"]).to_numpy()] = _flat(own["x"]).to_numpy()
        self.history.append(Sums(totals, flat))
        self.spread = self.rows.sparkSession.createDataFrame(pa.table(
            {"e": pa.concat_arrays([pa.array([], pa.string()), *(self.types.value.keys.take(pa.array(e)) for e, _ in flat.values())]),
             "f": pa.array([name for name, (e, _) in flat.items() for _ in e], pa.string()),
             "t": pa.array(np.concatenate([[], *(x / totals[e] for e, x in flat.values())]), pa.float64())}), "e string, f string, t double") if flat else None
        return True

    def _cells(self, chosen) -> DataFrame:
        given, prune, salts, types = self._given, self.prune_below, self.lay.salts, self.types

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names = types.value.keys
            for p in _parts(batches):
                t = p.probabilities(given.value, prune)
                fs = p.f.to_pylist()
                at = chosen(p, t, np.array([f not in salts for f in fs])[p.cell_f] & (t > 0))
                for lo in range(0, len(at), ENTRIES_AT_ONCE):
                    some = at[lo:lo + ENTRIES_AT_ONCE]
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(p.cell_e[some])), p.f.take(pa.array(p.cell_f[some])), pa.array(t[some])], ["e", "f", "t"])

        out = map_arrow(self.rows, run, "e string, f string, t double")
        return out.unionByName(self.spread.filter(F.col("t") >= max(prune, 5e-324))) if self.spread is not None else out

    def table(self) -> DataFrame:
        """``e, f, t`` after the steps so far."""
        return self._cells(lambda p, t, own: np.flatnonzero(own))

    def leading(self, exclude: tuple[str, ...], within: float) -> DataFrame:
        """Of ``table()`` without the target types ``exclude`` at least those rows whose ``t`` is ``within`` that number of the largest of their source
        type, of equal ``t`` the smallest target: chosen inside each part, so only few rows leave it."""
        def chosen(p: Part, t: np.ndarray, own: np.ndarray) -> np.ndarray:
            return p.leading(t, own & np.array([f not in exclude for f in p.f.to_pylist()])[p.cell_f], within)

        return self._cells(chosen).filter(~F.col("f").isin(list(exclude)))


    def losses(self, pairs: DataFrame, key_cols: list[str], src_col: str, trg_col: str, lam: float) -> DataFrame:
        """``key_cols, n_tok, sum_nll`` of every pair after the steps so far, scored where the training pairs of its targets are: one shuffle to
        the parts and one of sums by key."""
        given, lay, prune, base = self._given, self.lay, self.prune_below, lam / max(1, self.lay.targets)
        names = [f"k{i}" for i in range(len(key_cols))]
        rows = _in_blocks(pairs, key_cols, src_col, trg_col, lay, self.types, True)
        lists = rows.schema.fields[len(_BLOCK_NAMES):]
        own = self.rows.select(*_BLOCK_NAMES, *[F.lit(None).cast(f.dataType).alias(f.name) for f in lists], F.lit(0).alias("what"))
        both = own.unionByName(rows.withColumn("what", F.lit(1))).repartition(lay.parts, "part").sortWithinPartitions("part", "what")
        at = len(_BLOCK_NAMES)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, blocks, scorer = None, [], None
            for b in batches:
                for i, (part, what) in enumerate(zip(b.column(0).to_pylist(), b.column(at + len(names)).to_pylist(), strict=True)):
                    if part != now:
                        now, blocks, scorer = part, [], None
                    if not what:
                        blocks.append(_read(b, i))
                        continue
                    if scorer is None:
                        scorer = Scorer(now, Part(blocks) if blocks else None, given.value, lay, prune)
                        blocks = []
                    n, nll = scorer.score(_read(b, i), lam, base)
                    yield pa.RecordBatch.from_arrays([*(b.column(at + j)[i].values for j in range(len(names))), pa.array(n, pa.int64()), pa.array(nll, pa.float64())],
                                                     [*names, "n", "s"])

        schema = StructType([*[StructField(f.name, f.dataType.elementType) for f in lists], *StructType.fromDDL("n bigint, s double").fields])
        out = map_arrow(both, run, schema).groupBy(*names).agg(F.sum("n").alias("n_tok"), F.sum("s").alias("sum_nll"))
        return out.select(*[F.col(n).alias(k) for n, k in zip(names, key_cols)], "n_tok", "sum_nll")


class Scorer:
    """The probabilities of a part in the order of target and source type; spread types have those of all their parts."""

    def __init__(self, part: int, cells: Part | None, history: list[Sums], lay: Layout, prune_below: float):
        names, self.codes, self.t = [], np.zeros(0, np.int64), np.zeros(0)
        if cells is not None:
            names, self.codes, self.t = cells.f.to_pylist(), cells.codes, cells.probabilities(history, prune_below)
        sums = history[-1]
        spread = [f for f, n in lay.salts.items() if f in sums.spread and part in {lay.part_of(f, i) for i in range(n)}]
        if spread:
            here = ~np.isin(self.codes >> 32, [j for j, f in enumerate(names) if f in spread])
            names += [f for f in spread if f not in names]
            codes, t = [self.codes[here]], [self.t[here]]
            for f in spread:
                e, x = sums.spread[f]
                codes.append(names.index(f) << 32 | e)
                t.append(x / sums.totals[e])
            codes, t = np.concatenate(codes), np.concatenate(t)
            order = np.argsort(codes, kind="stable")
            self.codes, self.t = codes[order], np.where(t[order] < prune_below, 0.0, t[order])
        self.f = pa.array(names, pa.string())

    def score(self, b: Block, lam: float, base: float) -> tuple[np.ndarray, np.ndarray]:
        """Target labels of each pair in this part, and their summed negative log probability."""
        f = _places(b.f, self.f)[b.f_at]
        row = np.repeat(np.arange(len(b.n_trg)), b.n_trg)
        begin, size = (np.cumsum(b.n_src) - b.n_src)[row], b.n_src[row]
        total, done = np.zeros(len(row)), np.cumsum(size)
        lo = 0
        while lo < len(row):  # some whole targets at a time, whatever the pairs' lengths
            hi = max(lo + 1, int(np.searchsorted(done, done[lo] - size[lo] + CELLS_AT_ONCE, side="right")))
            at = _spans(begin[lo:hi], size[lo:hi])
            if len(self.codes):
                code = np.repeat(f[lo:hi], size[lo:hi]) << 32 | b.e[at]  # below zero if the target type is not here
                found = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
                first = np.cumsum(size[lo:hi]) - size[lo:hi]
                total[lo:hi] = np.add.reduceat(np.where(self.codes[found] == code, b.ce[at] * self.t[found], 0.0), first)
            lo = hi
        nll = -b.cf * np.log((1 - lam) * total / b.length[row] + base)
        first = np.cumsum(b.n_trg) - b.n_trg
        return np.add.reduceat(b.cf, first), np.add.reduceat(nll, first)


def _flat(column: pa.ChunkedArray) -> pa.Array:
    got = column.combine_chunks()
    return pa.concat_arrays(got.chunks) if isinstance(got, pa.ChunkedArray) else got


def _source_types(pairs: DataFrame, src_col: str):
    """Broadcast of the source types with both marks, None if they and a number for each are too large for that."""
    found = pairs.select(F.explode(F.col(src_col)).alias("e")).filter("e IS NOT NULL").distinct()
    found = materialize(found.unionByName(pairs.sparkSession.createDataFrame([(SOS,), (EOS,)], "e string")).distinct())
    if not fits_arrays(found.withColumn("x", F.lit(0.0))):
        return None
    names = _flat(found.toArrow()["e"])
    return pairs.sparkSession.sparkContext.broadcast(Entries(names, pa.array(np.arange(len(names)))))


def _in_blocks(pairs: DataFrame, key_cols: list[str], src_col: str, trg_col: str, lay: Layout, types, with_keys: bool) -> DataFrame:
    """``pairs`` as blocks; with lists of their key columns (as ``k0``, ``k1``, ...) if they are scored."""
    salt = F.pmod(F.xxhash64(*key_cols), F.lit(1 << 30)).cast("long")
    keys = [F.col(k).alias(f"k{i}") for i, k in enumerate(key_cols)] if with_keys else []
    rows = pairs.select(*keys, salt.alias("salt"), F.col(src_col).alias("src"), F.col(trg_col).alias("trg"))
    schema = StructType([*StructType.fromDDL(_BLOCK).fields, *[StructField(f.name, ArrayType(f.dataType)) for f in rows.schema.fields[:len(keys)]]])
    return map_arrow(rows, _blocked(lay, types, len(keys)), schema)


def training(pairs: DataFrame, key_cols: list[str], src_col: str, trg_col: str, prune_below: float = 0.0,
             cells_per_part: int = CELLS_PER_PART) -> Training:
    lay = layout(pairs, src_col, trg_col, cells_per_part)
    types = _source_types(pairs, src_col)
    if types is None:
        return Training(None, lay, prune_below, [])
    rows = _in_blocks(pairs, key_cols, src_col, trg_col, lay, types, False)
    return Training(materialize(rows.repartition(lay.parts, "part").sortWithinPartitions("part")), lay, prune_below, [], types)


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries ``part, e, f, t`` as a list of each part, for some ``ENTRIES_AT_ONCE`` entries at a time: a row for every entry would cost
    the exchange more than scoring does."""
    def lists(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        part = rows.column(0).to_numpy()
        order = np.argsort(part, kind="stable")
        begin = np.flatnonzero(np.diff(part[order], prepend=-1))
        offsets = pa.array(np.append(begin, len(order)).astype(np.int32))
        values = [rows.column(c).combine_chunks().take(pa.array(order)) for c in (1, 2, 3)]
        values = [v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v for v in values]
        return pa.RecordBatch.from_arrays([pa.array(part[order][begin], pa.int32()), *(pa.ListArray.from_arrays(offsets, v) for v in values)],
                                          ["part", "e", "f", "t"])

    held, n = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            n += b.num_rows
        if n >= ENTRIES_AT_ONCE:
            yield lists(held)
            held, n = [], 0
    if held:
        yield lists(held)


class Columns:
    """A part's entries ``t(f|e)`` as sorted arrays."""

    def __init__(self):
        self.given: list[tuple[pa.Array, pa.Array, pa.Array]] = []
        self.codes: np.ndarray | None = None

    def add(self, e: pa.Array, f: pa.Array, t: pa.Array) -> None:
        self.given.append((e, f, t))

    def _sort(self) -> None:
        e, f, t = (pa.chunked_array([x[i] for x in self.given], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.float64())))
        self.given = []
        self.e, self.f = pc.unique(e), pc.unique(f)
        codes = _places(f, self.f) * max(1, len(self.e)) + _places(e, self.e)
        order = np.argsort(codes, kind="stable")
        self.codes, self.t = codes[order], t.to_numpy()[order]

    def score(self, src: pa.Array, ce: pa.Array, length: pa.Array, trg: pa.Array, cf: pa.Array, lam: float, base: float) -> tuple[np.ndarray, np.ndarray]:
        """Target labels of each pair in this part, and their summed negative log probability."""
        if self.codes is None:
            self._sort()
        n_src, n_trg = (pc.list_value_length(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in (src, trg))
        e, f = _places(src.flatten(), self.e), _places(trg.flatten(), self.f)
        times, weight = cf.flatten().to_numpy(zero_copy_only=False), ce.flatten().to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(n_trg)), n_trg)
        begin, size = (np.cumsum(n_src) - n_src)[row], n_src[row]
        total = np.zeros(len(row))
        done = np.cumsum(size)
        lo = 0
        while lo < len(row):  # some whole targets at a time, whatever the pairs' lengths
            hi = max(lo + 1, int(np.searchsorted(done, done[lo] - size[lo] + CELLS_AT_ONCE, side="right")))
            first = np.cumsum(size[lo:hi]) - size[lo:hi]
            cell = np.arange(int(size[lo:hi].sum())) + np.repeat(begin[lo:hi] - first, size[lo:hi])
            of_f = np.repeat(f[lo:hi], size[lo:hi])
            code = np.where((of_f >= 0) & (e[cell] >= 0), of_f * max(1, len(self.e)) + e[cell], -1)
            if len(self.codes):
                found = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
                total[lo:hi] = np.add.reduceat(np.where(self.codes[found] == code, weight[cell] * self.t[found], 0.0), first)
            lo = hi
        nll = -times * np.log((1 - lam) * total / length.to_numpy(zero_copy_only=False)[row] + base)
        first = np.cumsum(n_trg) - n_trg
        return np.add.reduceat(times, first).astype(np.int64), np.add.reduceat(nll, first)


def _places(values, known: pa.Array) -> np.ndarray:
    """The place of each value among ``known`` ones, -1 if it is not there."""
    return pc.fill_null(pc.index_in(values, value_set=known), -1).to_numpy().astype(np.int64)


def losses(table: DataFrame, n_target_types: int, pairs: DataFrame, key_cols: list[str], src_col: str, trg_col: str, lam: float,
           cells_per_part: int = CELLS_PER_PART) -> DataFrame:
    """``key_cols, n_tok, sum_nll`` of every pair under the table ``e, f, t``; one shuffle to the parts and one of sums by key."""
    lay = layout(pairs, src_col, trg_col, cells_per_part)
    lay.parts = max(lay.parts, -(-table.count() // cells_per_part))  # few pairs may be scored under a large table
    rows = packed(pairs, key_cols, src_col, trg_col, lay, True)
    names = [f"k{i}" for i in range(len(key_cols))]
    place = F.pmod(F.crc32(F.concat(F.lit("0:"), F.col("f")).cast("binary")), F.lit(lay.parts)).cast("int")
    probs = table.select("e", "f", "t")
    entry = probs.withColumn("part", place)
    if lay.salts:  # the columns of spread types go to each of their parts: as many copies as parts hold them
        hot = table.sparkSession.createDataFrame([(f, sorted({lay.part_of(f, s) for s in range(n)})) for f, n in lay.salts.items()], "f string, ps array<int>")
        entry = (probs.join(F.broadcast(hot), "f", "left")
                 .withColumn("part", F.explode(F.coalesce("ps", F.array(F.pmod(F.crc32(F.concat(F.lit("0:"), F.col("f")).cast("binary")), F.lit(lay.parts)).cast("int"))))).drop("ps"))
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    listed = map_arrow(entry.select("part", "e", "f", "t"), _listed, "part int, e array<string>, f array<string>, t array<double>")
    as_rows = listed.select("part", F.lit(0).alias("what"), "e", "f", "t", *[F.lit(None).cast(kinds[c]).alias(c) for c in [*names, "src", "ce", "len", "trg", "cf"]])
    nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in listed.schema.fields[1:]]
    both = as_rows.unionByName(rows.select("part", F.lit(1).alias("what"), *nothing, *names, "src", "ce", "len", "trg", "cf"))
    both = both.repartition(lay.parts, "part").sortWithinPartitions("part", "what")
    base = lam / max(1, n_target_types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, columns = None, None
        for b in batches:
            parts, what = (b.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            # slices of one part and one kind of row, in the order of the rows
            ends = np.flatnonzero((np.diff(parts) != 0) | (np.diff(what) != 0)) + 1
            for lo, hi in zip([0, *ends.tolist()], [*ends.tolist(), b.num_rows]):
                if hi == lo:
                    continue
                if parts[lo] != now:
                    now, columns = parts[lo], Columns()
                rows_ = b.slice(lo, hi - lo)
                if what[lo] == 0:
                    columns.add(*(rows_.column(c).flatten() for c in (2, 3, 4)))
                    continue
                at = 5 + len(names)
                n, nll = columns.score(*rows_.columns[at:at + 5], lam, base)
                yield pa.RecordBatch.from_arrays([*rows_.columns[5:at], pa.array(n, pa.int64()), pa.array(nll, pa.float64())], [*names, "n", "s"])

    schema = StructType([*[f for f in rows.schema.fields if f.name in names], *StructType.fromDDL("n bigint, s double").fields])
    out = map_arrow(both, run, schema).groupBy(*names).agg(F.sum("n").alias("n_tok"), F.sum("s").alias("sum_nll"))
    return out.select(*[F.col(n).alias(k) for n, k in zip(names, key_cols)], "n_tok", "sum_nll")
