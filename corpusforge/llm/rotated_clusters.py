"""Centroid clustering in integers, with candidates filtered in PCA-rotated coordinates.

Vectors become integers.  Their covariance, summed over all rows, gives a rotation onto the
principal axes.  For every vector the leading rotated coordinates and the norm of the rest are
stored once.  Rotations keep distances, and the rest of a difference is at least as long as the difference of the rests'
norms, so for a vector and a centroid ``|lead - lead_c|^2 + (rest - rest_c)^2`` never exceeds their squared distance.
A round measures each vector's most promising centroid in whole integers, drops every centroid whose lower bound
lies above that, and measures the others in integers too; so floating point never decides an assignment.

Tasks send the driver sums of each cluster's members, which are exact integers; the new centroid is their
mean, rounded down.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusforge.llm.common import in_arrow, stored
from corpusforge.llm.vectors import cell_sums, integer_rows

DIMS, SCALE, CLUSTERS, ROUNDS = 64, 64, 16, 3
# Larger components become this, so that squared distances of up to 64 components are long integers.
LIMIT = 1 << 27
# The leading coordinates hold this share of the variance, within these numbers.
SHARE, LEAST_LEAD, MOST_LEAD = 0.9, 4, 32
# Lower bounds are lowered by this share of the squared lengths, far more than they can be off by rounding.
SLACK = 1e-6


@dataclass
class Rotation:
    """Principal axes: ``mean`` of all vectors and the leading axes as columns."""

    mean: np.ndarray
    axes: np.ndarray

    def apply(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Leading coordinates, norm of the rest, and squared length, all from the mean."""
        moved = vectors - self.mean
        lead = moved @ self.axes
        length = np.einsum("ij,ij->i", moved, moved)
        return lead, np.sqrt(np.maximum(0.0, length - np.einsum("ij,ij->i", lead, lead))), length


def principal_axes(n: float, sums: np.ndarray, products: np.ndarray) -> Rotation:
    """Rotation from the number of vectors, their sum and the sums of products of their components."""
    mean = sums / n
    values, axes = np.linalg.eigh(products / n - np.outer(mean, mean))
    values, axes = np.maximum(values[::-1], 0), axes[:, ::-1]
    share = np.cumsum(values) / max(values.sum(), 1e-300)
    lead = int(np.clip(np.searchsorted(share, SHARE) + 1, LEAST_LEAD, MOST_LEAD))
    return Rotation(mean, np.ascontiguousarray(axes[:, :lead]))


def nearest(vectors: np.ndarray, lead: np.ndarray, rest: np.ndarray, length: np.ndarray, centroids: np.ndarray,
            rotation: Rotation) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid of each vector (of equal ones the first), squared distance, and how many distances were measured."""
    c_lead, c_rest, c_length = rotation.apply(centroids.astype(np.float64))
    bound = (np.einsum("ij,ij->i", lead, lead)[:, None] + np.einsum("ij,ij->i", c_lead, c_lead) - 2 * lead @ c_lead.T
             + (rest[:, None] - c_rest) ** 2 - SLACK * (length[:, None] + c_length + 1))

    def measured(rows: np.ndarray, which: np.ndarray) -> np.ndarray:
        apart = vectors[rows] - centroids[which]
        return np.einsum("ij,ij->i", apart, apart)

    every = np.arange(len(vectors))
    best = np.argmin(bound, axis=1)
    distance = measured(every, best)
    first, count = best.copy(), len(vectors)
    for j in range(len(centroids)):
        rows = np.flatnonzero((bound[:, j] <= distance) & (first != j))
        if len(rows):
            count += len(rows)
            d = measured(rows, np.full(len(rows), j))
            closer = (d < distance[rows]) | ((d == distance[rows]) & (j < best[rows]))
            distance[rows[closer]] = d[closer]
            best[rows[closer]] = j
    return best, distance, count


def _matrix(column: pa.Array, kind: str, width: int) -> np.ndarray:
    """Fixed-width binary values as rows of a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(len(column), width)


def clusters(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = DIMS, scale: int = SCALE,
             k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = 1) -> DataFrame:
    """``id_col, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every vector that takes part.

    Vectors with exactly ``dims`` components, none null or non-finite, take part; others, empty and null ones too, are not in
    the result.  Each component becomes ``floor(scale * x)`` (beyond 2**27 in size: that limit).  The first centroids are the ``k`` vectors
    with the smallest SHA-256 of ``seed:id`` (fewer if there are fewer; ties: the vector's bytes); vectors with a null id are
    assigned but are never first centroids.  A repeated row counts each time and comes out each time.  ``rounds`` times
    every vector goes to its nearest centroid (ties: smaller number) and each centroid with members becomes their mean, rounded
    down; then vectors are assigned once more.  No vector at all, or none with an id, gives no rows.  Other columns are ignored.
    """
    spark = vectors.sparkSession
    source = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    kind = source.schema["id"].dataType.simpleString()

    def as_integers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            whole, usable = integer_rows(b.column(1), scale, LIMIT, dims, True)
            data = [x.tobytes() for x in whole[usable].astype("<i4")]
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(usable)), pa.array(data, pa.binary())], ["id", "v"])

    rows = in_arrow(source, as_integers, f"id {kind}, v binary")
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    starts = rows.filter("id IS NOT NULL").orderBy(order, "v").limit(k).collect()
    schema = f"id {kind}, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    if not starts:
        return spark.createDataFrame([], schema).withColumnRenamed("id", id_col)
    centroids = np.stack([np.frombuffer(r["v"], dtype="<i4") for r in starts]).astype(np.int64)

    def moments(b: pa.RecordBatch) -> np.ndarray:
        x = _matrix(b.column(1), "<i4", dims).astype(np.float64)
        return np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x).ravel()])

    m = cell_sums(rows, moments)
    total = np.array([m[i] for i in range(1 + dims + dims * dims)])
    rotation = principal_axes(total[0], total[1:dims + 1], total[dims + 1:].reshape(dims, dims))
    width = rotation.axes.shape[1]

    def rotate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                lead, rest, length = rotation.apply(_matrix(b.column(1), "<i4", dims).astype(np.float64))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x.tobytes() for x in lead.astype("<f8")], pa.binary()),
                                                  pa.array(rest), pa.array(length)], ["id", "v", "lead", "rest", "length"])

    table = stored(in_arrow(rows, rotate, f"id {kind}, v binary, lead binary, rest double, length double"), "rotated")

    def assigned(b: pa.RecordBatch, now: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = _matrix(b.column(1), "<i4", dims).astype(np.int64)
        best, distance, _ = nearest(x, _matrix(b.column(2), "<f8", width), b.column(3).to_numpy(), b.column(4).to_numpy(), now, rotation)
        return x, best, distance

    for _ in range(rounds):
        def member_sums(b: pa.RecordBatch, now: np.ndarray = centroids) -> np.ndarray:
            x, best, _ = assigned(b, now)
            out = np.zeros((len(now), dims + 1), dtype=np.int64)
            for j in np.unique(best):
                out[j, :dims] = x[best == j].sum(axis=0)
            out[:, dims] = np.bincount(best, minlength=len(now))
            return out.ravel()

        found = cell_sums(table, member_sums, "bigint")
        of = np.array([found[i] for i in range(len(centroids) * (dims + 1))], dtype=np.int64).reshape(-1, dims + 1)
        held = of[:, dims] > 0
        centroids = np.where(held[:, None], of[:, :dims] // np.maximum(of[:, dims:], 1), centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                _, best, distance = assigned(b, centroids)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(best.astype(np.int32)), pa.array(distance)], ["id", "cluster", "distance"])

    out = stored(in_arrow(table, assign, f"id {kind}, cluster int, distance bigint"), "clusters")
    sums = {r["cluster"]: r["d"] for r in out.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}  # at most k rows
    names = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    each = spark.createDataFrame([(j, sums[j], sum(sums.values()), names[j]) for j in sums],
                                 "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return out.join(F.broadcast(each), "cluster").select(
        F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
