"""Unigram subword vocabulary (SUB1, the language-model kind): training, encoding.

A word is a sequence of pieces drawn independently, so its probability is the sum over all ways of cutting it
into pieces (a lattice).  Training works on the word-type table:

* seeds: all characters, and the substrings of words with the largest count times length;
* EM: expected piece counts by forward and backward sums over each word's lattice, added up in one aggregate;
* pruning: how much likelihood would be lost if a piece were cut into others; the pieces with the smallest loss go,
  a quarter of all in a round, until the vocabulary has its size.

Tasks work on distinct words in Arrow batches with the piece table, which is bounded by ``seeds`` pieces.  Expected counts are
added in whole units of ``2**-20``, so the model does not depend on the partitioning.  Texts are encoded
by the most probable cutting (Viterbi).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusforge.operators.subword import SPECIAL_PIECES, VOCAB_SIZE, _chars, encode_with, word_table
from corpusforge.session import map_arrow, materialize

# Longest piece, pieces to begin with per piece wanted, share kept by a round, EM steps of a round.
MAX_PIECE, SEEDS_PER_PIECE, KEEP, EM_STEPS = 16, 10, 0.75, 2
# Expected counts are added in these parts of one.
UNIT = 1 << 20
# Substrings whose counts a task holds before it hands them on.
TASK_PIECES = 500_000
# Characters of distinct words that are worth a task of their own, and that a task takes at most, about.
TASK_SYMBOLS, MOST_SYMBOLS = 1 << 14, 1 << 18
# A character that is no piece: this much less likely than the least likely piece.
UNKNOWN_PENALTY = 10.0


@dataclass
class UnigramPieces:
    """Log probability of each piece; ids follow the special pieces by falling probability."""

    logp: dict[str, float]
    history: list  # (pieces, log likelihood per word token) after each EM step

    @property
    def ids(self) -> dict[str, int]:
        order = sorted(self.logp, key=lambda p: (-self.logp[p], p))
        return {p: i for i, p in enumerate((*SPECIAL_PIECES, *order))}

    def vocab(self, spark) -> DataFrame:
        return spark.createDataFrame(list(self.ids.items()), "piece string, id int")


def _floor(logp: dict[str, float]) -> float:
    return min(logp.values(), default=0.0) - UNKNOWN_PENALTY


def expected_counts(word: str, logp: dict[str, float], longest: int, floor: float) -> tuple[float, dict[str, float]]:
    """Log probability of a word, and how often each piece is expected in its cuttings."""
    n = len(word)
    arcs: list[list[tuple[int, str, float]]] = [[] for _ in range(n + 1)]  # by end: begin, piece, log probability
    alpha = [0.0] * (n + 1)
    for j in range(1, n + 1):
        here = arcs[j]
        for i in range(max(0, j - longest), j):
            p = word[i:j]
            s = logp.get(p)
            if s is None:
                if j - i > 1:
                    continue
                s = floor
            here.append((i, p, s))
        top = max(alpha[i] + s for i, _, s in here)
        alpha[j] = top + math.log(math.fsum(math.exp(alpha[i] + s - top) for i, _, s in here))
    beta = [-math.inf] * n + [0.0]
    out: dict[str, float] = {}
    for j in range(n, 0, -1):
        b = beta[j]
        for i, p, s in arcs[j]:
            x = s + b
            hi, lo = (beta[i], x) if beta[i] > x else (x, beta[i])
            beta[i] = hi + math.log1p(math.exp(lo - hi))
            out[p] = out.get(p, 0.0) + math.exp(alpha[i] + s + b - alpha[n])
    return alpha[n], out


def best_pieces(word: str, logp: dict[str, float], longest: int, floor: float, without: str | None = None) -> list[str]:
    """The most probable cutting (ties: the longer last piece); ``without`` leaves a piece out."""
    n = len(word)
    best, back = [0.0] + [-math.inf] * n, [0] * (n + 1)
    for j in range(1, n + 1):
        for i in range(max(0, j - longest), j):
            p = word[i:j]
            s = logp.get(p) if p != without else None
            if s is None:
                if j - i > 1:
                    continue
                s = floor
            if best[i] + s > best[j]:
                best[j], back[j] = best[i] + s, i
    out, j = [], n
    while j:
        out.append(word[back[j]:j])
        j = back[j]
    return out[::-1]


def digamma(x: float) -> float:
    """Derivative of the log gamma function, for x > 0."""
    shift = 0.0
    while x < 8:
        shift -= 1 / x
        x += 1
    y = 1 / (x * x)
    return shift + math.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y / 240)))


def reestimated(counts: dict[str, float], chars: set[str]) -> dict[str, float]:
    """Log probabilities from expected counts, rare pieces damped by the digamma function; pieces expected less than half a time
    go, characters stay."""
    if not counts:
        return {}
    kept = {p: max(c, 0.5) for p, c in counts.items() if c >= 0.5 or p in chars}
    total = digamma(sum(kept[p] for p in sorted(kept)))
    return {p: digamma(c) - total for p, c in kept.items()}


def seed_pieces(words: DataFrame, chars: list[str], seeds: int, longest: int = MAX_PIECE) -> dict[str, float]:
    """Characters and the ``seeds`` substrings of at least two characters, met more than once, with the largest count times length."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(found: dict[str, int]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["piece", "n"])

        found: dict[str, int] = {}
        for b in batches:
            for word, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for i in range(len(word)):
                    for j in range(i + 1, min(len(word), i + longest) + 1):
                        p = word[i:j]
                        found[p] = found.get(p, 0) + n
                if len(found) > TASK_PIECES:
                    yield rows(found)
                    found = {}
        yield rows(found)

    counts = materialize(map_arrow(words.select("word", "freq"), run, "piece string, n bigint").groupBy("piece").agg(F.sum("n").alias("n")))
    longer = (counts.filter((F.char_length("piece") > 1) & (F.col("n") > 1))
              .withColumn("w", F.col("n") * F.char_length("piece")).orderBy(F.desc("w"), "piece").limit(seeds))
    single = counts.filter(F.char_length("piece") == 1)
    rows = {r["piece"]: float(r["n"]) for r in longer.select("piece", "n").unionByName(single).collect()}  # at most seeds + characters
    total = math.log(sum(rows.values())) if rows else 0.0
    return {p: math.log(n) - total for p, n in rows.items()}


def _per_word(words: DataFrame, logp: dict[str, float], counts_of) -> tuple[float, dict[str, float]]:
    """Sums over all word types, by frequency: log likelihood, and counts of each piece from ``counts_of(word, model)``."""
    given = words.sparkSession.sparkContext.broadcast((logp, max(map(len, logp), default=1), _floor(logp)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = given.value
        units: dict[str, int] = {}  # at most one number for each piece
        total = 0
        for b in batches:
            for word, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                score, counts = counts_of(word, model)
                total += round(score * UNIT) * n
                for p, c in counts.items():
                    units[p] = units.get(p, 0) + round(c * UNIT) * n
        yield pa.RecordBatch.from_arrays([pa.array([None, *units], pa.string()), pa.array([total, *units.values()], pa.int64())], ["piece", "units"])

    out = map_arrow(words.select("word", "freq"), run, "piece string, units bigint")
    rows = out.groupBy("piece").agg(F.sum(F.col("units").cast("decimal(38,0)")).alias("units")).collect()  # one per piece
    sums = {r["piece"]: int(r["units"]) / UNIT for r in rows}
    given.unpersist()
    return sums.pop(None, 0.0), sums


def em_step(words: DataFrame, logp: dict[str, float], chars: set[str]) -> tuple[float, dict[str, float]]:
    """Log likelihood of all words under ``logp``, and the next log probabilities."""
    likelihood, counts = _per_word(words, logp, lambda w, m: expected_counts(w, *m))
    return likelihood, reestimated({p: counts.get(p, 0.0) for p in logp}, chars)


def losses(words: DataFrame, logp: dict[str, float]) -> dict[str, float]:
    """What removing a piece of several characters would cost: its count in the best cuttings times the log
    probability lost by cutting it into its most probable other pieces."""
    def counted(word, model):
        out: dict[str, float] = {}
        for p in best_pieces(word, *model):
            out[p] = out.get(p, 0.0) + 1.0
        return 0.0, out

    _, counts = _per_word(words, logp, counted)
    spark = words.sparkSession
    given = spark.sparkContext.broadcast((logp, max(map(len, logp), default=1), _floor(logp)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, longest, floor = given.value
        for b in batches:
            lost = [n * (table[p] - sum(table.get(x, floor) for x in best_pieces(p, table, longest, floor, without=p)))
                    for p, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lost, pa.float64())], ["piece", "loss"])

    longer = [(p, counts.get(p, 0.0)) for p in sorted(logp) if len(p) > 1]
    if not longer:
        return {}
    pieces = spark.createDataFrame(longer, "piece string, n double").repartition(spark.sparkContext.defaultParallelism)
    return {r["piece"]: r["loss"] for r in map_arrow(pieces, run, "piece string, loss double").collect()}


def train_unigram(df: DataFrame, text_col: str, vocab_size: int = VOCAB_SIZE, seeds_per_piece: int = SEEDS_PER_PIECE,
                  em_steps: int = EM_STEPS, keep: float = KEEP) -> UnigramPieces:
    """SUB1 (unigram).  The vocabulary has ``vocab_size`` pieces with the special ones, or all characters if they are more,
    or fewer if the texts have no more pieces.  Null and empty texts have no words; an empty table gives no pieces."""
    words = word_table(df, text_col, TASK_SYMBOLS, MOST_SYMBOLS)
    chars = {r["c"] for r in words.select(F.explode(_chars(F.col("word"))).alias("c")).distinct().collect()}  # at most all characters there are
    tokens = words.agg(F.sum("freq")).first()[0] or 0
    logp = seed_pieces(words, sorted(chars), seeds_per_piece * vocab_size)
    wanted = max(len(chars), vocab_size - len(SPECIAL_PIECES))
    history = []
    while True:
        for _ in range(em_steps):
            size = len(logp)
            likelihood, logp = em_step(words, logp, chars)
            history.append((size, likelihood / tokens if tokens else 0.0))
        if len(logp) <= wanted or not tokens:
            return UnigramPieces(logp, history)
        lost = losses(words, logp)
        room = max(wanted, int(keep * len(logp))) - len(chars)
        stay = sorted(lost, key=lambda p: (-round(lost[p], 6), p))[:max(0, room)]
        logp = {p: logp[p] for p in (*sorted(chars), *stay)}


def encode(model: UnigramPieces, df: DataFrame, key_cols: list[str], text_col: str, out_col: str = "ids") -> DataFrame:
    """SUB2 for the unigram vocabulary: the most probable pieces of every word, in place; unknown characters are ``<unk>``."""
    return encode_with(df, key_cols, text_col, model.ids, _segment, (model.logp, max(map(len, model.logp), default=1), _floor(model.logp)), out_col)


def _segment(word: str, model: tuple) -> list[str]:
    return best_pieces(word, *model)
