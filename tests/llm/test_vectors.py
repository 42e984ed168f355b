"""Hard negatives and clusters of vectors against brute force."""

import hashlib
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusforge.llm import hard_negatives, rotated_clusters, vectors

SCHEMA = "vec_id long, embedding array<float>, label int"
CLASH = ("id", "v", "score", "rank", "search", "tile", "cluster", "lead", "block", "cuts", "c0", "s0")


def frame(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    for name in CLASH:
        df = df.withColumn(name, F.lit("clash"))
    return df


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def whole(v, scale, width):
    out = [math.floor(scale * float(np.float32(x))) for x in v]
    return out + [0] * (width - len(out))


def brute_negatives(rows):
    width = max((len(v) for _, v, lab in rows if v is not None and lab is not None), default=0)
    kept = sorted({(i, lab, tuple(whole(v, 256, width))) for i, v, lab in rows if i is not None and lab is not None and usable(v)})
    out = []
    for a in [r for r in kept if r[0] % 50 == 0]:
        score = lambda r: sum(x * y for x, y in zip(a[2], r[2]))
        same = sorted((-score(r), r[0]) for r in kept if r[1] == a[1] and r != a)[:5]
        other = sorted((-score(r), r[0]) for r in kept if r[1] != a[1])
        for s, p in same:
            near = [(t, n) for t, n in other if 50 * -s <= 100 * -t <= 95 * -s][:3]
            out += [(a[0], p, k + 1, n, -s, -t) for k, (t, n) in enumerate(near)]
    return sorted(out)


def vectors_of(rng, n, width, kinds=4, spread=0.4):
    centres = rng.normal(size=(kinds, width))
    return [(i, (centres[i % kinds] + spread * rng.normal(size=width)).astype(np.float32).tolist(), int(rng.integers(kinds))) for i in range(n)]


ODD = [(1000, None, 1), (1001, [], 2), (1002, [1.0, None], 1), (1003, [float("nan")] * 6, 1), (1004, [float("inf")] * 6, 0), (None, [0.5] * 6, 1),
       (1050, [0.5] * 6, None), (1100, [0.25, -0.5], 1), (1150, [0.0] * 6, 2), (1200, [0.3] * 6, 3), (1200, [0.3] * 6, 3), (1200, [0.2] * 6, 3)]


def found(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("case", ["mixed", "many equal", "wide values", "small tiles"])
def test_hard_negatives_match_brute_force(spark, case, monkeypatch):
    rng = np.random.default_rng(len(case))
    rows = vectors_of(rng, 400, 6)
    if case == "mixed":
        rows += ODD
    if case == "many equal":  # a third of all rows and ties throughout
        rows = [(i, [round(x, 1) for x in v] if i % 3 else [0.5] * 6, lab) for i, v, lab in rows]
    if case == "wide values":
        rows = [(i, [x * 1e5 for x in v], lab) for i, v, lab in rows]
    if case != "wide values":
        monkeypatch.setattr(hard_negatives, "TILE_ROWS", 40)
        monkeypatch.setattr(hard_negatives, "LEAF", 5)
        monkeypatch.setattr(hard_negatives, "GROUP", 3)
    if case == "small tiles":
        monkeypatch.setattr(hard_negatives, "BLOCK", 2)
    got = found(hard_negatives.hard_negatives(frame(spark, rows), F.col("vec_id") % 50 == 0))
    assert got == brute_negatives(rows) and got


def test_no_vectors(spark):
    any_ = F.col("vec_id") >= 0
    assert found(hard_negatives.hard_negatives(frame(spark, []), any_)) == []
    assert found(hard_negatives.hard_negatives(frame(spark, ODD[:7]), any_)) == []
    assert found(hard_negatives.hard_negatives(frame(spark, vectors_of(np.random.default_rng(1), 5, 3)), F.col("vec_id") < 0)) == []
    assert found(rotated_clusters.clusters(frame(spark, []))) == []
    assert found(rotated_clusters.clusters(frame(spark, ODD))) == []


def test_boxes_are_left_out_but_no_result():
    """Bounds hold for every vector of a box, and well-parted data opens few boxes."""
    rng = np.random.default_rng(2)
    rows = np.floor(256 * (np.repeat(np.eye(8), 250, axis=0) + 0.02 * rng.normal(size=(2000, 8))))
    labels = np.repeat(np.arange(8), 250)
    tree = hard_negatives.Tree.build(np.arange(2000), labels, rows, list(range(3)))
    assert sorted(tree.ids.tolist()) == list(range(2000)) and max(np.diff(tree.starts)) <= hard_negatives.LEAF
    low, high = tree.levels[-1]
    s = hard_negatives.Searches(np.array([10]), np.array([0]), rows[[10]], np.array([0]), np.array([-1e18]), np.array([1e18]), True, 5)
    least, most = s.bounds(np.array([0]), low, high)
    scores = rows[10] @ tree.vectors.T
    for i, (a, b) in enumerate(zip(tree.starts, tree.starts[1:])):
        assert least[0, i] <= scores[a:b].min() and scores[a:b].max() <= most[0, i]
    s.run(tree)
    want = sorted((-x, i) for i, x in enumerate(rows[:250] @ rows[10]) if i != 10)[:5]
    assert list(zip((-s.score[0]).tolist(), s.id[0].tolist())) == want
    assert s.measured < 1000
    again = hard_negatives.Tree.unpack(tree.pack("<i2"), "<i2", 8, np.dtype("f8"))
    assert (again.vectors == tree.vectors).all() and all((a == b).all() for x, y in zip(again.levels, tree.levels) for a, b in zip(x, y))


def test_integer_rows():
    rows = [None, [], [1.0, None], [float("nan"), 1.0], [0.5, -0.5], [1e30, 0.001], [1.0, 2.0, 3.0]]
    values, ok = vectors.integer_rows(pa.array(rows, pa.list_(pa.float32())), 64, 1 << 20, 2, True)
    assert ok.tolist() == [False, False, False, False, True, True, False]
    assert values[4].tolist() == [32, -32] and values[5].tolist() == [1 << 20, 0]
    assert vectors.integer_rows(pa.array(rows, pa.list_(pa.float32())), 64, 1 << 20, 3, False)[1].tolist() == [False, True, False, False, True, True, True]


def brute_clusters(rows, dims=64, k=16, rounds=3):
    kept = [(i, whole(v, 64, dims)) for i, v, _ in rows if v is not None and len(v) == dims and usable(v)]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    packed = lambda v: np.array(v, "<i4").tobytes()
    centroids = [v for _, v in sorted((r for r in kept if r[0] is not None), key=lambda r: (sha(f"1:{r[0]}"), packed(r[1])))[:k]]

    def assign():
        return [min((sum((x - y) ** 2 for x, y in zip(v, c)), j) for j, c in enumerate(centroids)) for _, v in kept]
    for _ in range(rounds):
        to = assign()
        for j in range(len(centroids)):
            mine = [v for (_, v), (_, c) in zip(kept, to) if c == j]
            if mine:
                centroids[j] = [sum(x) // len(mine) for x in zip(*mine)]
    to = assign()
    per = {j: sum(d for d, c in to if c == j) for j in range(len(centroids))}
    return sorted(((i, c, d, per[c], sum(per.values()), sha(",".join(map(str, centroids[c])))) for (i, _), (d, c) in zip(kept, to)), key=str)


@pytest.mark.parametrize("case", ["spread", "few values", "fewer than centroids", "all equal"])
def test_clusters_match_brute_force(spark, case):
    rng = np.random.default_rng(7)
    rows = vectors_of(rng, 300, 64, kinds=9)
    if case == "few values":  # ties between centroids, repeated rows
        rows = [(i // 2, [float(x > 0) for x in v[:3]] + [0.0] * 61, 1) for i, v, _ in rows]
    if case == "fewer than centroids":
        rows = rows[:7] + [(None, [0.1] * 64, 1), (3, None, 1), (4, [1.0] * 63, 1), (5, [float("nan")] * 64, 1), (6, [], None), (8, [None] * 64, 2), (9, [1e30] * 64, 1)]
        rows[-1] = (9, [2e6] * 64, 1)
    if case == "all equal":
        rows = [(i, [0.3] * 64, 1) for i in range(40)]
    got = sorted((tuple(r) for r in rotated_clusters.clusters(frame(spark, rows)).collect()), key=str)
    assert got == brute_clusters(rows)


def test_filter_leaves_centroids_out():
    """Lower bounds hold, and distances to most centroids are never measured on vectors with a few main axes."""
    rng = np.random.default_rng(9)
    x = np.floor(64 * (rng.normal(size=(3000, 6)) @ rng.normal(size=(6, 64)) + 0.05 * rng.normal(size=(3000, 64)))).astype(np.int64)
    c = x[rng.choice(3000, 16, replace=False)]
    f = x.astype(np.float64)
    rotation = rotated_clusters.principal_axes(len(f), f.sum(axis=0), f.T @ f)
    lead, rest, length = rotation.apply(f)
    best, distance, measured = rotated_clusters.nearest(x, lead, rest, length, c, rotation)
    real = ((x[:, None] - c[None]) ** 2).sum(axis=2)
    assert (best == real.argmin(axis=1)).all() and (distance == real.min(axis=1)).all()
    assert measured < 0.2 * real.size and lead.shape[1] < 10
    c_lead, c_rest, _ = rotation.apply(c.astype(np.float64))
    bound = ((lead[:, None] - c_lead[None]) ** 2).sum(axis=2) + (rest[:, None] - c_rest[None]) ** 2
    assert (bound <= real * (1 + 1e-6) + 1).all()


def test_random_windows_and_ties():
    """Searches over several trees, one after another, with tied scores and narrow windows."""
    rng = random.Random(5)
    for _ in range(20):
        n = rng.randint(1, 300)
        x = np.array([[rng.randint(-2, 2) for _ in range(4)] for _ in range(n)], dtype=np.float64)
        labels = np.array([rng.randint(0, 2) for _ in range(n)])
        ids = np.array(rng.sample(range(10 ** 6), n))
        cut = rng.randint(0, n)
        trees = [hard_negatives.Tree.build(ids[a:b], labels[a:b], x[a:b], [0, 1]) for a, b in ((0, cut), (cut, n)) if b > a]
        lo = rng.randint(-8, 8)
        s = hard_negatives.Searches(ids[:3], labels[:3], x[:3], np.arange(len(ids[:3])), np.full(len(ids[:3]), float(lo)), np.full(len(ids[:3]), float(lo + 3)), False, 3)
        for t in trees:
            s.run(t)
        for a in range(len(ids[:3])):
            want = sorted((-sc, int(i)) for sc, i, lab in zip(x @ x[a], ids, labels) if lab != labels[a] and lo <= sc <= lo + 3)[:3]
            got = [(-sc, int(i)) for sc, i in zip(s.score[a], s.id[a]) if sc > hard_negatives.NONE]
            assert got == want
