"""Vocabulary build and look-ups (AGG1, WIN4, JOI6, JOI7, SNK7).

A vocabulary is a table ``(token STRING, freq LONG, id INT)``: ids 0..3 are
the specials, then tokens by frequency descending, ties by token ascending
(code-point order in both Spark and DuckDB).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusforge.functions.text import SPECIALS, UNK
from corpusforge.operators.lookup import map_arrays, share
from corpusforge.operators.ordering import dense_index


def token_counts(df: DataFrame, tokens_col: str, token_col: str = "token") -> DataFrame:
    """``explode`` + ``groupBy(token).count()`` with map-side partial counts.

    A plain ``explode`` would make the tokens twice: the optimizer puts a filter on the array's size before it.
    """
    return (df.select(F.posexplode_outer(F.col(tokens_col)).alias("_p", token_col)).filter("_p IS NOT NULL")
            .groupBy(token_col).agg(F.count(F.lit(1)).alias("freq")))


def build_vocab(df: DataFrame, tokens_col: str, min_freq: int = 1,
                specials: tuple[str, ...] = SPECIALS) -> DataFrame:
    """AGG1 + WIN4: count tokens, keep ``freq >= min_freq``, rank after the specials."""
    spark = df.sparkSession
    counts = token_counts(df, tokens_col).filter(
        (F.col("freq") >= min_freq) & ~F.col("token").isin(list(specials)))
    ranked = dense_index(counts, [F.col("freq").desc(), F.col("token").asc()], "id", start=len(specials))
    specials_df = spark.createDataFrame([(s, None, i) for i, s in enumerate(specials)],
                                        "token string, freq long, id long")
    return specials_df.unionByName(ranked.select("token", "freq", "id")) \
                      .withColumn("id", F.col("id").cast("int"))


def numericalize(df: DataFrame, key_cols: list[str], tokens_col: str, vocab: DataFrame,
                 out_col: str = "ids", unk_id: int = 0) -> DataFrame:
    """JOI6: token -> id with ``<unk>`` fallback, in place and in order; no tokens give no ids."""
    table = share(vocab.select("token", "id"), "token", "id")
    rows = df.select(*key_cols, F.col(tokens_col).alias("_a"))
    return map_arrays(rows, "_a", table, out_col, unk_id, key_cols=key_cols).select(*key_cols, out_col)


def denumericalize(df: DataFrame, key_cols: list[str], ids_col: str, vocab: DataFrame,
                   out_col: str = "tokens") -> DataFrame:
    """JOI7: id -> token, in place and in order; unknown ids map to ``<unk>``, no ids to no tokens."""
    table = share(vocab.select("id", "token"), "id", "token")
    rows = df.select(*key_cols, F.col(ids_col).alias("_a"))
    return map_arrays(rows, "_a", table, out_col, UNK, key_cols=key_cols).select(*key_cols, out_col)
