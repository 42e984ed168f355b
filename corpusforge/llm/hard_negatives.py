"""Hard negatives by best-first search in STR-packed R-trees.

Vectors become integers.  Sort-tile-recursive packing deals the rows into tiles: slices of equal
numbers of rows along the coordinate that varies most, each cut again along the next ones; a fraction from
the row's id parts rows with equal coordinates, so that many equal vectors spread over many
tiles.  Each tile is packed in the same way into leaves and becomes an R-tree, one row of the stored index: boxes hold
the smallest and largest value of every coordinate.

For a query vector each coordinate of a box gives an interval of products, and their sums bound the
scores of all vectors in the box.  A task searches its trees for a block of queries (broadcast, of bounded size),
in groups of neighbours: a queue gives the box with the highest bound first, and a box is left out for
a query if its interval lies outside the query's score window or strictly below the k-th best score so far.
Each task hands on its k best per search; Spark keeps the k best of all tasks.  No row is left out
otherwise: the result is exact.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusforge.llm import words
from corpusforge.llm.common import in_arrow, stored
from corpusforge.llm.vectors import cell_sums, integer_rows
from corpusforge.operators.joins import join_small

SCALE = 256
POSITIVES, NEGATIVES = 5, 3
# A negative's score lies within these hundredths of the positive's.
LOW, HIGH = 50, 95
# Rows of a tile, vectors of a leaf, children of an inner box, coordinates that rows are dealt by.
TILE_ROWS, LEAF, FANOUT, SORTED_BY = 2048, 64, 8, 3
# Anchors of a block, which the driver and each task hold whole, and anchors that share a queue.
BLOCK, GROUP = 16_384, 64
# Below every score.
NONE = -(1 << 62)


def component_limit(dims: int) -> int:
    """Larger components become this, so that a score fits a long integer."""
    return min(1 << 27, math.isqrt((1 << 61) // max(1, dims)))


def str_order(vectors: np.ndarray, coords: list[int], leaf: int) -> tuple[np.ndarray, np.ndarray]:
    """Sort-tile-recursive: an order of the rows, and where each leaf of at most ``leaf`` rows begins in it."""
    def pack(rows: np.ndarray, depth: int) -> list[np.ndarray]:
        leaves = -(-len(rows) // leaf)
        if leaves <= 1:
            return [rows]
        rows = rows[np.argsort(vectors[rows, coords[depth]], kind="stable")]
        left = len(coords) - depth
        slices = leaves if left == 1 else math.ceil(leaves ** (1 / left) - 1e-9)
        size = -(-leaves // slices) * leaf
        return [x for a in range(0, len(rows), size) for x in (pack(rows[a:a + size], depth + 1) if left > 1 else [rows[a:a + size]])]

    parts = pack(np.arange(len(vectors)), 0)
    return np.concatenate(parts), np.cumsum([0, *map(len, parts)])[:-1]


@dataclass
class Tree:
    """An R-tree: levels of boxes from the root down; box ``i`` of a level holds boxes ``FANOUT*i`` onwards of the next."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    starts: np.ndarray                         # of the leaves, with the number of rows at the end
    levels: list[tuple[np.ndarray, np.ndarray]]  # smallest and largest values

    @classmethod
    def build(cls, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, coords: list[int]) -> Tree:
        order, starts = str_order(vectors, coords, LEAF)
        ids, labels, vectors = ids[order], labels[order], vectors[order]
        levels = [(np.minimum.reduceat(vectors, starts), np.maximum.reduceat(vectors, starts))]
        while len(levels[0][0]) > 1:
            at = np.arange(0, len(levels[0][0]), FANOUT)
            levels.insert(0, (np.minimum.reduceat(levels[0][0], at), np.maximum.reduceat(levels[0][1], at)))
        return cls(ids, labels, vectors, np.append(starts, len(ids)), levels)

    def pack(self, kind: str) -> tuple:
        """As the fields of an index row."""
        boxes = np.concatenate([np.concatenate(x) for x in self.levels]).astype(kind).tobytes()
        return (len(self.ids), [len(x[0]) for x in self.levels], self.starts.astype("<i4").tobytes(), self.ids.astype("<i8").tobytes(),
                self.labels.astype("<i8").tobytes(), self.vectors.astype(kind).tobytes(), boxes)

    @classmethod
    def unpack(cls, row: tuple, kind: str, dims: int, work: np.dtype) -> Tree:
        n, sizes, starts, ids, labels, vectors, boxes = row
        flat = np.frombuffer(boxes, dtype=kind).reshape(-1, dims).astype(work)
        cut = np.cumsum([0, *(2 * s for s in sizes)])
        levels = [(flat[a:a + s], flat[a + s:a + 2 * s]) for a, s in zip(cut, sizes)]
        return cls(np.frombuffer(ids, "<i8"), np.frombuffer(labels, "<i8"), np.frombuffer(vectors, kind).reshape(n, dims).astype(work),
                   np.frombuffer(starts, "<i4"), levels)


@dataclass
class Searches:
    """Searches of a block: each has a query vector (an anchor's), a score window, and its best ``k`` so far."""

    anchor_ids: np.ndarray
    anchor_labels: np.ndarray
    anchors: np.ndarray       # vectors, one per row
    anchor: np.ndarray        # of each search, ascending
    low: np.ndarray
    high: np.ndarray
    same_label: bool
    k: int

    def __post_init__(self):
        self.score = np.full((len(self.anchor), self.k), NONE, dtype=self.anchors.dtype)
        self.id = np.full((len(self.anchor), self.k), np.iinfo(np.int64).max)
        self.plus, self.minus = np.maximum(self.anchors, 0), np.minimum(self.anchors, 0)
        self.first = np.searchsorted(self.anchor, np.arange(len(self.anchors) + 1))
        self.boxes = self.measured = 0  # boxes opened and vectors measured, for tests

    def bounds(self, rows: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Smallest and largest possible scores of anchors with the vectors in boxes."""
        plus, minus = self.plus[rows], self.minus[rows]
        return plus @ low.T + minus @ high.T, plus @ high.T + minus @ low.T

    def run(self, tree: Tree) -> None:
        for a in range(0, len(self.anchors), GROUP):
            rows = np.arange(a, min(a + GROUP, len(self.anchors)))
            todo = np.arange(self.first[rows[0]], self.first[rows[-1] + 1])
            if len(todo):
                self._group(tree, rows, todo)

    def _group(self, tree: Tree, rows: np.ndarray, todo: np.ndarray) -> None:
        """Best-first search for the anchors ``rows``, whose searches are ``todo``."""
        of, low, high = self.anchor[todo] - rows[0], self.low[todo], self.high[todo]
        queue: list[tuple] = []

        def push(level: int, begin: int, end: int) -> None:
            least, most = self.bounds(rows, tree.levels[level][0][begin:end], tree.levels[level][1][begin:end])
            least, most = least[of], most[of]
            floor = np.maximum(low, self.score[todo, -1])[:, None]
            open_ = (most >= floor) & (least <= high[:, None])
            hope = np.where(open_, np.minimum(most, high[:, None]), NONE)
            for i in np.flatnonzero(open_.any(axis=0)):
                heapq.heappush(queue, (-hope[:, i].max(), level, begin + int(i), most[:, i], open_[:, i]))

        push(0, 0, 1)
        while queue:
            _, level, box, most, open_ = heapq.heappop(queue)
            open_ = open_ & (most >= self.score[todo, -1])
            if not open_.any():
                continue
            self.boxes += 1
            if level + 1 < len(tree.levels):
                push(level + 1, box * FANOUT, min((box + 1) * FANOUT, len(tree.levels[level + 1][0])))
            else:
                self._leaf(tree, tree.starts[box], tree.starts[box + 1], todo[open_])

    def _leaf(self, tree: Tree, begin: int, end: int, todo: np.ndarray) -> None:
        mine = self.anchor[todo]
        rows, of = np.unique(mine, return_inverse=True)
        score = self.anchors[rows] @ tree.vectors[begin:end].T
        self.measured += score.size
        score = score[of]
        floor = np.maximum(self.low[todo], self.score[todo, -1])[:, None]
        labels = tree.labels[begin:end] == self.anchor_labels[mine][:, None]
        at, col = np.nonzero((score >= floor) & (score <= self.high[todo][:, None]) & (labels == self.same_label))
        if not len(at):
            return
        search, value, found = todo[at], score[at, col], tree.ids[begin:end][col]
        own = np.flatnonzero(found == self.anchor_ids[mine[at]])
        if len(own):  # an anchor is none of its own results
            keep = np.ones(len(at), dtype=bool)
            keep[own] = (tree.vectors[begin + col[own]] != self.anchors[mine[at[own]]]).any(axis=1) | (not self.same_label)
            search, value, found = search[keep], value[keep], found[keep]
        held = np.unique(search)
        old = self.score[held] > NONE
        search = np.concatenate([search, np.repeat(held, old.sum(axis=1))])
        value = np.concatenate([value, self.score[held][old]])
        found = np.concatenate([found, self.id[held][old]])
        order = np.lexsort((found, -value, search))
        search, value, found = search[order], value[order], found[order]
        first = np.searchsorted(search, search)
        place = np.arange(len(search)) - first
        top = place < self.k
        self.score[search[top], place[top]] = value[top]
        self.id[search[top], place[top]] = found[top]

    def results(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Search, score and id of all that was found."""
        at, place = np.nonzero(self.score > NONE)
        return at, self.score[at, place].astype(np.int64), self.id[at, place]


@dataclass
class Index:
    """Stored trees, one row each, and what is needed to search them."""

    trees: DataFrame
    rows: DataFrame      # id, label, v: the rows that take part, each once
    dims: int
    kind: str            # of stored components
    work: str            # of arithmetic: double where every score is exact, else 64-bit integer
    coords: list[int]


def _matrix(column: pa.Array, kind: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(len(column), width)


def _cuts(rows: DataFrame, column: str, slices: int, by: list[str]) -> DataFrame:
    """About equal slices of each group along a column: ``by`` and the inner limits."""
    shares = F.array(*[F.lit(i / slices) for i in range(1, slices)])
    return rows.groupBy(*by).agg(F.percentile_approx(column, shares, F.lit(100 * slices)).alias("cuts"))


def build(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
          scale: int = SCALE) -> Index | None:
    """The index of all rows that take part (see ``hard_negatives``); None if there are none."""
    source = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("v")) \
                    .filter("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL")
    dims = source.agg(F.max(F.size("v")).alias("d")).first()["d"]
    if dims is None:
        return None
    dims, limit = max(1, dims), component_limit(max(1, dims))

    def as_integers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            whole, usable = integer_rows(b.column(2), scale, limit, dims, False)
            kept = pa.array(usable)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(kept), b.column(1).filter(kept),
                                              pa.array([x.tobytes() for x in whole[usable].astype("<i4")], pa.binary())], ["id", "label", "v"])

    rows = stored(in_arrow(source, as_integers, "id bigint, label bigint, v binary").dropDuplicates(), "negatives-rows")
    found = cell_sums(rows, lambda b: np.concatenate([[b.num_rows], (x := _matrix(b.column(2), "<i4", dims).astype(np.float64)).sum(axis=0), (x * x).sum(axis=0)]))
    if not found:
        return None
    total = np.array([found[i] for i in range(2 * dims + 1)])
    n = int(total[0])
    variance = total[dims + 1:] / n - (total[1:dims + 1] / n) ** 2
    coords = np.argsort(-variance, kind="stable")[:SORTED_BY].tolist()

    def extremes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = 0
        for b in batches:
            if b.num_rows:
                most = max(most, int(np.abs(_matrix(b.column(2), "<i4", dims).astype(np.int64)).max()))
        yield pa.RecordBatch.from_arrays([pa.array([most])], ["most"])

    largest = in_arrow(rows, extremes, "most bigint").agg(F.max("most")).first()[0]
    kind = "<i2" if largest < 1 << 15 else "<i4"
    work = "f8" if dims * largest * largest < 1 << 53 else "i8"
    tiles = -(-n // TILE_ROWS)
    slices = math.ceil(tiles ** (1 / len(coords)) - 1e-9)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(2), "<i4", dims)
            part = words.mix(b.column(0).to_numpy().astype(np.int64).view(np.uint64)) / 2.0 ** 64
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(x[:, c] + part) for c in coords]], ["id", "label", "v", *[f"c{i}" for i in range(len(coords))]])

    at = in_arrow(rows, placed, "id bigint, label bigint, v binary, " + ", ".join(f"c{i} double" for i in range(len(coords))))
    by: list[str] = []
    if slices > 1:
        at = stored(at, "negatives-coordinates")
        for i in range(len(coords)):
            cuts = _cuts(at, f"c{i}", slices, by)
            if by:  # a row of limits for each slice so far: one number per tile at the last step
                at = join_small(at, cuts, by)
            else:
                at = at.withColumn("cuts", F.array(*map(F.lit, cuts.first()["cuts"])))
            at = at.withColumn(f"s{i}", F.expr(f"size(filter(cuts, x -> x <= c{i}))")).drop("cuts")
            by.append(f"s{i}")
    tile = sum((F.col(s).cast("long") * slices ** i for i, s in enumerate(by)), F.lit(0).cast("long"))
    tasks = max(min(tiles, vectors.sparkSession.sparkContext.defaultParallelism), -(-tiles // 64))
    sorted_rows = at.select(tile.alias("tile"), "id", "label", "v").repartition(tasks, "tile").sortWithinPartitions("tile")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def packed() -> pa.RecordBatch:
            ids, labels, v = (np.concatenate(x) for x in zip(*held, strict=True))
            out = []
            for a in range(0, len(ids), 2 * TILE_ROWS):  # limits are approximate: a tile that came out larger makes several trees
                z = slice(a, a + 2 * TILE_ROWS)
                out.append(Tree.build(ids[z], labels[z], v[z], coords).pack(kind))
            kinds = [pa.int32(), pa.list_(pa.int32()), *[pa.binary()] * 5]
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), kinds)], _FIELDS)

        for b in batches:
            tile_no, ids, labels = (b.column(i).to_numpy() for i in range(3))
            v = _matrix(b.column(3), "<i4", dims)
            cut = np.flatnonzero(np.diff(tile_no)) + 1
            for part in np.split(np.arange(b.num_rows), cut):
                if len(part):
                    if held and tile_no[part[0]] != now:
                        yield packed()
                        held = []
                    now = tile_no[part[0]]
                    held.append((ids[part], labels[part], v[part]))
        if held:
            yield packed()

    trees = stored(in_arrow(sorted_rows, pack, "n int, sizes array<int>, starts binary, ids binary, labels binary, vectors binary, boxes binary"), "negatives-trees")
    return Index(trees, rows, dims, kind, work, coords)


_FIELDS = ["n", "sizes", "starts", "ids", "labels", "vectors", "boxes"]


def best(index: Index, block: tuple, anchor: np.ndarray, low: np.ndarray, high: np.ndarray, same_label: bool, k: int) -> DataFrame:
    """``search, rank, id, score``: the ``k`` best rows of each search over all trees, equal scores by smaller id.

    ``block``: ids, labels and vectors of the anchors; search ``i`` has the vector of ``anchor[i]`` (ascending).
    """
    spark = index.trees.sparkSession
    work, kind, dims = np.dtype(index.work), index.kind, index.dims
    given = spark.sparkContext.broadcast((*block, anchor, low.astype(work), high.astype(work)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, vectors, of, lo, hi = given.value
        searches = Searches(ids, labels, vectors.astype(work), of, lo, hi, same_label, k)
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                searches.run(Tree.unpack(row, kind, dims, work))
        found = searches.results()
        for a in range(0, len(found[0]), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[a:a + 100_000]) for x in found], ["search", "score", "id"])

    found = in_arrow(index.trees.select(*_FIELDS), run, "search bigint, score bigint, id bigint")
    order = Window.partitionBy("search").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, anchors: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                   scale: int = SCALE, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``anchors``: which rows are anchors, a condition on ``id_col``.  A score is the inner product of the vectors ``floor(scale * x)``.
    An anchor's positives are its first ``positives`` other rows of its label (higher scores first, ties by smaller id); for each,
    the first ``negatives`` rows of other labels whose score lies within ``low`` to ``high`` hundredths of the positive's are returned.
    Fewer are returned where there are fewer; a positive with none has no row, and so has every positive with a negative score, whose window is empty.

    Rows with a null id, label or vector, or with a null or non-finite component, take no part.  Rows that are equal in id, label and vector count
    once; rows that share only the id are different rows, and each may be an anchor.  Shorter vectors, empty ones too, are
    filled up with zeros.  Components beyond ``component_limit`` become the limit.  An empty table gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    schema = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    index = build(vectors, id_col, vector_col, label_col, scale)
    empty = spark.createDataFrame([], schema)
    if index is None:
        return empty
    chosen = stored(index.rows.withColumnRenamed("id", id_col).filter(anchors).withColumnRenamed(id_col, "id"), "negatives-anchors")
    blocks = -(-chosen.count() // BLOCK)
    chosen = chosen.withColumn("block", F.pmod(F.xxhash64("id", "label", "v"), F.lit(max(1, blocks))))
    out = empty
    for i in range(blocks):  # a block is about BLOCK rows, whatever the table's size
        table = chosen.filter(F.col("block") == i).select("id", "label", "v").toArrow()
        if not table.num_rows:
            continue
        v = np.frombuffer(b"".join(table["v"].to_pylist()), "<i4").reshape(-1, index.dims)
        order, _ = str_order(v, index.coords, GROUP)  # anchors that share a queue lie near each other
        block = (table["id"].to_numpy()[order], table["label"].to_numpy()[order], v[order].astype(index.kind))
        every = np.arange(len(v))
        near = best(index, block, every, np.full(len(v), NONE + 1), np.full(len(v), -NONE), True, positives).collect()  # at most positives * BLOCK rows
        pairs = sorted((r["search"], r["rank"], r["id"], r["score"]) for r in near)
        windows = [(a, p, s) for a, _, p, s in pairs if -(-low * s // 100) <= high * s // 100]
        if not windows:
            continue
        lo, hi = (np.array(x, dtype=np.int64) for x in zip(*((-(-low * s // 100), high * s // 100) for *_, s in windows), strict=True))
        found = best(index, block, np.array([a for a, *_ in windows]), lo, hi, False, negatives)
        of = spark.createDataFrame([(j, int(block[0][a]), p, s) for j, (a, p, s) in enumerate(windows)], "search bigint, anchor_id bigint, positive_id bigint, positive_score bigint")
        rows = found.join(F.broadcast(of), "search").select(  # at most positives * BLOCK rows
            "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        out = out.unionByName(stored(rows, "negatives-found"))
    return out
