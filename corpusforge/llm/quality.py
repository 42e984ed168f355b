"""Quality classifier on random-indexing word vectors.

Words fall into ``BUCKETS`` by hash; a few more entries stand for word shapes (upper
case, digits, a word repeated, ...).  Each entry has a sparse random index vector.  The
context vector of an entry is the sum of the index vectors of its neighbours over
*all* documents, summed by Spark.  A document is the mean of its words' index and
context vectors with some plain statistics, and a two-layer network, with a
temperature fitted on rows it did not train on, gives the probability.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusforge.llm import words
from corpusforge.llm.common import in_arrow, slices, stored, text_buffer, without

SHAPES = 16
BUCKETS = 2048 - SHAPES
ENTRIES = BUCKETS + SHAPES
DIM = 32
STATS = 9
# At most so many labelled rows train the network (those with the smallest hash of their id).
MAX_TRAIN = 20_000
HIDDEN = 24
# Text worked on at a time, as its words take some fifty times its size.
TEXT_BYTES = 1 << 18
EPOCHS = 60
# Share of the training rows kept back for the temperature.
CALIBRATION = 0.15
_SHAPE = {"lower": 0, "capital": 1, "upper": 2, "mixed": 3, "digits": 4, "symbols": 5, "repeat": 6, "symbol after letter": 7}
_UPPER = np.zeros(256, dtype=np.int64)
_UPPER[0x41:0x5B] = 1


def index_vectors() -> np.ndarray:
    """One sparse vector of +1 and -1 per entry, four of each, always the same."""
    rng = np.random.default_rng(20)
    out = np.zeros((ENTRIES, DIM))
    for row in out:
        at = rng.permutation(DIM)[:8]
        row[at[:4]], row[at[4:]] = 1.0, -1.0
    return out


def _entries(data: np.ndarray, offsets: np.ndarray) -> tuple[words.Words, np.ndarray, np.ndarray]:
    """Words with their entry and the entry of their shape."""
    w = words.split(data, offsets, words.text_classes())
    entry = (w.code % np.uint64(BUCKETS)).astype(np.int64) + SHAPES
    ups = np.concatenate([[0], np.cumsum(_UPPER[data])])
    n_up = ups[w.start + w.length] - ups[w.start]
    letter = w.kind == words.LETTER
    shape = np.full(len(entry), _SHAPE["lower"])
    shape[letter & (n_up > 0)] = _SHAPE["mixed"]
    if len(entry):
        shape[letter & (n_up == 1) & (_UPPER[data[w.start]] == 1)] = _SHAPE["capital"]
    shape[letter & (n_up >= 2) & (n_up >= w.length // 2)] = _SHAPE["upper"]
    shape[w.kind == words.DIGIT] = _SHAPE["digits"]
    symbol = w.kind == words.SYMBOL
    shape[symbol] = _SHAPE["symbols"]
    if len(entry) > 1:
        same_doc = w.doc[1:] == w.doc[:-1]
        touching = w.start[1:] == w.start[:-1] + w.length[:-1]
        shape[1:][symbol[1:] & (w.length[1:] > 1) & touching & letter[:-1] & same_doc] = _SHAPE["symbol after letter"]
        shape[1:][(w.code[1:] == w.code[:-1]) & same_doc] = _SHAPE["repeat"]
    return w, entry, shape


def _all_entries(batch: pa.RecordBatch, column: int) -> tuple[np.ndarray, ...]:
    """Row, hash, entry and shape of every word of a batch, whose texts are read ``TEXT_BYTES`` at a time."""
    parts, at = [], 0
    for b in slices(iter([batch]), column, TEXT_BYTES):
        w, entry, shape = _entries(*text_buffer(b.column(column)))
        parts.append((w.doc + at, w.code, entry, shape))
        at += b.num_rows
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def neighbours(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
    """How often each entry stands right before each other one in the texts of the first column."""
    pairs = np.zeros(ENTRIES * ENTRIES)
    for b in slices(batches, 0, TEXT_BYTES):
        w, entry, shape = _entries(*text_buffer(b.column(0)))
        near = np.flatnonzero(w.doc[1:] == w.doc[:-1])
        for left in (entry, shape):
            for right in (entry, shape):
                np.add.at(pairs, left[near] * ENTRIES + right[near + 1], 1.0)
    return pairs.reshape(ENTRIES, ENTRIES)


def context_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Unit context vectors of all entries, from every pair of adjacent words of every document."""
    rows = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    names = [f"d{i}" for i in range(DIM)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, square = index_vectors(), neighbours(batches)
        total = square @ index + square.T @ index
        out = pa.RecordBatch.from_arrays([pa.array(np.arange(ENTRIES)), *(pa.array(c) for c in total.T)], ["entry", *names])
        yield out

    sums = in_arrow(rows, run, "entry bigint, " + ", ".join(f"{n} double" for n in names)) \
        .groupBy("entry").agg(*(F.sum(n).alias(n) for n in names))
    out = np.zeros((ENTRIES, DIM))
    for r in sums.collect():  # ENTRIES rows
        out[r.entry] = [r[n] for n in names]
    return np.round(out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9), 6)


def features(docs: DataFrame, contexts: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, text_key, x``: the MD5 of the text and the pooled vector of every document (zeros but for the statistics without words)."""
    table = docs.sparkSession.sparkContext.broadcast(np.hstack([index_vectors(), contexts]).astype(np.float32))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.md5(text).alias("text_key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = table.value
        for b in slices(batches, 1):
            _, offsets = text_buffer(b.column(1))
            n = b.num_rows
            doc, code, entry, shape = _all_entries(b, 1)
            count = np.maximum(np.bincount(doc, minlength=n), 1).astype(float)
            pooled = np.empty((n, 2 * DIM), dtype=np.float32)
            for at in range(0, n, 256):
                lo, hi = np.searchsorted(doc, [at, min(n, at + 256)])
                row = (doc[lo:hi] - at) * ENTRIES
                size = min(256, n - at) * ENTRIES
                seen = np.bincount(row + entry[lo:hi], minlength=size) + np.bincount(row + shape[lo:hi], minlength=size)
                pooled[at:at + 256] = seen.reshape(-1, ENTRIES).astype(np.float32) @ vectors
            pooled /= count[:, None]
            size = np.maximum(np.diff(offsets), 1).astype(float)
            _, first = np.unique(code + words.mix(doc), return_index=True)
            shares = [np.bincount(doc[shape == s], minlength=n) / count for s in (2, 4, 5, 6, 7)]
            stats = np.column_stack([np.log1p(np.diff(offsets)) / 8, np.bincount(doc, minlength=n) / size * 4,
                                     np.bincount(doc[first], minlength=n) / count, *shares,
                                     np.linalg.norm(pooled, axis=1)])
            x = np.hstack([pooled, stats]).astype(np.float32)
            flat = pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), flat], ["id", "text_key", "x"])

    kind = rows.schema["id"].dataType.simpleString()
    return in_arrow(rows, run, f"id {kind}, text_key string, x array<float>")


class Network:
    """One hidden layer, a sigmoid, and a temperature; numpy only."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.mean, self.sd = x.mean(axis=0), x.std(axis=0) + 1e-3
        order = rng.permutation(len(x))
        cut = int(len(x) * CALIBRATION)
        held, train = order[:cut], order[cut:]
        z = (x - self.mean) / self.sd
        p = [rng.normal(0, z.shape[1] ** -0.5, (z.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN ** -0.5, HIDDEN), np.zeros(1)]
        first, second, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
        for _ in range(EPOCHS):
            for at in np.array_split(rng.permutation(train), max(1, len(train) // 256)):
                h = np.tanh(z[at] @ p[0] + p[1])
                e = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - y[at]) / len(at)
                back = np.outer(e, p[2]) * (1 - h * h)
                grads = [z[at].T @ back + 1e-4 * p[0], back.sum(axis=0), h.T @ e + 1e-4 * p[2], e.sum(keepdims=True)]
                step += 1
                for a, g, m, v in zip(p, grads, first, second, strict=True):  # Adam
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    a -= 0.003 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
        self.params, self.temperature = p, 1.0
        if len(held) >= 20:
            logits, t = self._logits(x[held]), y[held]
            grid = np.geomspace(0.25, 8, 41)
            loss = [np.mean(np.logaddexp(0, -np.where(t > 0, 1, -1) * logits / g)) for g in grid]
            self.temperature = float(grid[int(np.argmin(loss))])

    def _logits(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.params
        return np.tanh((x - self.mean) / self.sd @ a + b) @ c + d

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._logits(x) / self.temperature, -30, 30)))


def learnable(id_col: Column, parts: int, held: int) -> Column:
    """True where crc32 of the id as text leaves another remainder than ``held``; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.encode(id_col.cast("string"), "UTF-8")), F.lit(parts)) != held, F.lit(False))


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          parts: int = 5, held: int = 0, max_train: int = MAX_TRAIN) -> DataFrame:
    """``id_col, held_out, score, text_key``, one row per document; the score is that of label 1.

    Only labels of ids with ``crc32(id) mod parts <> held`` are learnt, at most ``max_train``
    of them.  ``text_key`` is the MD5 of the text, of which alone the score depends.  Null and empty texts are scored by their (zero) vector; null labels are
    ignored and of several labels of an id the largest counts; an id that occurs in several rows
    trains with each; null ids are never learnt and count as held out.
    Without labels the score is 0.5, with labels of one class that class's
    smoothed share.  An empty table gives an empty result; other columns are never read.
    """
    vectors = stored(features(docs, context_vectors(docs, text_col), id_col, text_col), "quality-vectors")
    known = (labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"))
             .filter(F.col("label").isNotNull() & learnable(F.col(id_col), parts, held))
             .groupBy("id").agg(F.max("label").alias("label"))
             .orderBy(F.xxhash64("id"), "id").limit(max_train))
    # at most max_train rows
    sample = vectors.join(F.broadcast(known), "id").orderBy(F.xxhash64("id"), "id").limit(max_train).collect()
    y = np.array([r.label for r in sample], dtype=float)
    if 0 < y.sum() < len(y):
        network = Network(np.array([r.x for r in sample], dtype=float), y)
    else:
        network = (y.sum() + 0.5) / (len(y) + 1)
    model = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1).astype(float)
            s = model.value.scores(x) if isinstance(model.value, Network) else np.full(len(x), model.value)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.round(s, 6))], ["id", "text_key", "score"])

    kind = vectors.schema["id"].dataType.simpleString()
    return in_arrow(vectors, run, f"id {kind}, text_key string, score double").select(
        F.col("id").alias(id_col), (~learnable(F.col("id"), parts, held)).alias("held_out"), "score", "text_key")


def drop_rejected(docs: DataFrame, labels: DataFrame, least: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the texts that score less than ``least``, all columns kept."""
    scores = score(docs, labels, id_col, text_col)
    bad = stored(scores.filter(F.col("score") < least).select("text_key").distinct(), "quality-rejected")
    return without(docs, bad, lambda c: F.md5(F.coalesce(c(text_col), F.lit(""))) == F.col("_gone_text_key"))
