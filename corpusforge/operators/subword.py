"""Subword vocabulary: byte-pair-encoding training, encoding and decoding (SUB1-SUB3).

Training works on the *word-type table* ``(word, freq)``: the text is split into words once
(``explode`` + ``groupBy``), and every pass works on distinct words, never on the running corpus.  The merges
are those of plain one-at-a-time BPE (count descending, ties: smaller pair first) whatever
``merges_per_round`` is; see ``bpe_train`` for how a round proves several of them at once.

Vocabulary ids: 0 unk, 1 bos, 2 eos, 3 pad, then the base characters
(frequency descending, character ascending), then merged pieces in merge
order.  A merge rank is that of the pair's first merge.  Encoding and decoding map the texts or ids of an Arrow batch in place with the
broadcast merge table, whose size the vocabulary bounds; rows are neither exploded nor regrouped.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from corpusforge.functions.text import (SUBWORD_BOS_ID, SUBWORD_EOS_ID, SUBWORD_PAD_ID,
                                        SUBWORD_UNK_ID, WHITESPACE, WORD_START)
from corpusforge.operators import bpe_train
from corpusforge.operators.ordering import dense_index
from corpusforge.session import map_arrow, materialize

VOCAB_SIZE = 10_000
SPECIAL_PIECES = ("<unk>", "<s>", "</s>", "<pad>")
# Distinct words whose pieces a Python worker keeps at hand.
KNOWN_WORDS = 200_000
# Characters of distinct words (each word's end counts as one) that are worth a task of their own in training, and that a task takes at most, about.
TASK_SYMBOLS, MOST_SYMBOLS = 1 << 17, 1 << 20


@dataclass
class BpeModel:
    merges: list            # [(rank, a, b)]
    vocab: DataFrame        # (piece, id)
    words: DataFrame        # (word, freq, pieces) segmentation of the training words
    rounds: int = 0


def words_of(text: Column) -> Column:
    """Whitespace words, each marked with the word-start symbol."""
    parts = F.filter(F.split(text, WHITESPACE), lambda x: F.length(x) > 0)
    return F.transform(parts, lambda w: F.concat(F.lit(WORD_START), w))


def _chars(word: Column) -> Column:
    return F.filter(F.split(word, ""), lambda x: F.length(x) > 0)


def word_types(df: DataFrame, text_col: str) -> DataFrame:
    """``(word, freq, syms)`` where ``syms`` is the word's symbol array."""
    w = df.select(F.explode(words_of(F.col(text_col))).alias("word")) \
          .groupBy("word").agg(F.count(F.lit(1)).alias("freq"))
    return w.withColumn("syms", _chars(F.col("word")))


def pair_counts(words: DataFrame) -> DataFrame:
    """Adjacent symbol pairs weighted by word frequency: ``(a, b, n)``."""
    s = F.col("syms")
    pairs = F.arrays_zip(F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0))).alias("a"),
                         F.slice(s, 2, F.greatest(F.size(s) - 1, F.lit(0))).alias("b"))
    return (words.select("freq", F.explode(pairs).alias("p"))
            .groupBy(F.col("p.a").alias("a"), F.col("p.b").alias("b"))
            .agg(F.sum("freq").alias("n")))


def word_table(df: DataFrame, text_col: str, least: int, most: int) -> DataFrame:
    """``(word, freq)``, materialised in as many partitions as its characters are worth, whatever the session's shuffle partitions.

    Training passes over this table hundreds of times, so a task must have more to do than it costs to start: one has at least
    ``least`` symbols, about, while there are idle cores, and at most ``most``.
    """
    spark = df.sparkSession
    words = materialize(df.select(F.explode(words_of(F.col(text_col))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("freq")))
    symbols = words.agg(F.sum(F.char_length("word").cast("long") + 1)).first()[0] or 0
    tasks = max(min(spark.sparkContext.defaultParallelism, -(-symbols // least)), -(-symbols // most), 1)
    return materialize(words.repartition(tasks, "word"))


def train_bpe(df: DataFrame, text_col: str, vocab_size: int = VOCAB_SIZE,
              merges_per_round: int = bpe_train.TOP, min_count: int = 2) -> BpeModel:
    """SUB1.  The merge list stays on the driver; it is bounded by ``vocab_size``.

    ``merges_per_round`` only bounds how many merges a round may commit; the result is the same for every value.
    """
    spark = df.sparkSession
    words = word_table(df, text_col, TASK_SYMBOLS, MOST_SYMBOLS)
    chars = materialize(words.select("freq", F.explode(_chars(F.col("word"))).alias("piece"))
                        .groupBy("piece").agg(F.sum("freq").alias("n")))
    alphabet = sorted(r["piece"] for r in chars.select("piece").collect())  # at most all characters there are
    budget = max(0, vocab_size - len(SPECIAL_PIECES) - len(alphabet))
    found, seg, rounds = bpe_train.train(words, alphabet, budget, merges_per_round, min_count)
    merges = [(rank, a, b) for rank, (a, b) in enumerate(found)]
    base = chars.select("piece", F.lit(0).alias("_g"), (-F.col("n")).alias("_o1"), F.col("piece").alias("_o2"))
    merged = spark.createDataFrame([(a + b, 1, r, "") for r, a, b in merges],
                                   "piece string, _g int, _o1 long, _o2 string")
    pieces = dense_index(base.unionByName(merged), ["_g", "_o1", "_o2"], "id", start=len(SPECIAL_PIECES))
    specials = spark.createDataFrame([(p, i) for i, p in enumerate(SPECIAL_PIECES)], "piece string, id long")
    # a merged piece can equal a base character or an earlier piece: keep its first id
    vocab = materialize(specials.unionByName(pieces.select("piece", "id"))
                        .groupBy("piece").agg(F.min("id").cast("int").alias("id")))
    return BpeModel(merges, vocab, seg, rounds)


def merge_ranks(merges: list) -> dict:
    """Pair -> rank; a pair that was merged again later keeps its first rank."""
    ranks: dict = {}
    for r, a, b in merges:
        ranks.setdefault((a, b), r)
    return ranks


def _apply_merges(word: str, ranks: dict) -> list:
    """Pieces of a word: again and again the pair of the smallest rank, leftmost first (a heap over linked symbols)."""
    sym = list(word)
    n = len(sym)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, sym[i], sym[i + 1]) for i in range(n - 1) if (r := ranks.get((sym[i], sym[i + 1]))) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if sym[i] != a or j >= n or sym[j] != b:
            continue
        sym[i], sym[j] = a + b, None
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            r = ranks.get((sym[i], sym[k]))
            if r is not None:
                heapq.heappush(heap, (r, i, sym[i], sym[k]))
        h = before[i]
        if h >= 0:
            r = ranks.get((sym[h], sym[i]))
            if r is not None:
                heapq.heappush(heap, (r, h, sym[h], sym[i]))
    return [x for x in sym if x is not None]


def _with_array(df: DataFrame, key_cols: list[str], in_col: str, out: StructField, of_value) -> DataFrame:
    """``key_cols`` and ``out``, computed from ``in_col`` by ``of_value`` (built once per task) in Arrow batches."""
    rows = df.select(*key_cols, F.col(in_col).alias("_in"))
    schema = StructType([*rows.schema.fields[:-1], out])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        fn = of_value()
        kind = to_arrow_type(out.dataType)
        for b in batches:
            got = pa.array([fn(x) for x in b.column(b.num_columns - 1).to_pylist()], kind)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], got], [*key_cols, out.name])

    return map_arrow(rows, run, schema)


def encode_with(df: DataFrame, key_cols: list[str], text_col: str, ids: dict, segment, shared, out_col: str = "ids") -> DataFrame:
    """Texts to piece ids in place: ``segment(word, shared value)`` cuts each distinct word once per worker cache."""
    sc = df.sparkSession.sparkContext
    given = sc.broadcast((ids, shared))

    def build():
        numbers, model = given.value
        known: dict[str, list[int]] = {}

        def of_text(text: str | None) -> list[int]:
            out: list[int] = []
            for word in (text or "").split():
                got = known.get(word)
                if got is None:
                    if len(known) >= KNOWN_WORDS:
                        known.clear()
                    got = known[word] = [numbers.get(p, SUBWORD_UNK_ID) for p in segment(WORD_START + word, model)]
                out += got
            return out
        return of_text

    return _with_array(df, key_cols, text_col, StructField(out_col, ArrayType(IntegerType())), build)


def piece_ids(vocab: DataFrame) -> dict[str, int]:
    """Piece -> id on the driver: as many entries as the vocabulary has, which its size parameter bounds."""
    return {r["piece"]: r["id"] for r in vocab.collect()}


def encode(model: BpeModel, df: DataFrame, key_cols: list[str], text_col: str,
           out_col: str = "ids") -> DataFrame:
    """SUB2: text -> piece ids, one row per row; a null text has none, a character outside the vocabulary is ``<unk>``."""
    return encode_with(df, key_cols, text_col, piece_ids(model.vocab), _apply_merges, merge_ranks(model.merges), out_col)


def decode(model: BpeModel, df: DataFrame, key_cols: list[str], ids_col: str,
           out_col: str = "text") -> DataFrame:
    """SUB3: ids -> text; control ids vanish and the word-start symbol becomes a space."""
    given = df.sparkSession.sparkContext.broadcast({i: p for p, i in piece_ids(model.vocab).items()})
    control = {SUBWORD_UNK_ID, SUBWORD_BOS_ID, SUBWORD_EOS_ID, SUBWORD_PAD_ID}

    def build():
        pieces = given.value

        def of_ids(ids: list[int] | None) -> str:
            return "".join(pieces.get(i, "") for i in ids or () if i not in control).replace(WORD_START, " ").strip(" ")
        return of_ids

    return _with_array(df, key_cols, ids_col, StructField(out_col, StringType()), build)


def normalize_spaces(text: Column) -> Column:
    """Whitespace runs -> one space, trimmed (the decode round-trip target)."""
    return F.trim(F.regexp_replace(text, WHITESPACE + "+", " "))
