"""Hooks for user-supplied models (UDF1-UDF4).

A user model (a neural scorer or translator, say) runs on the executors
through ``mapInPandas``: ``load()`` is called once per task, then every Arrow
batch of rows goes through ``fn(model, batch) -> DataFrame``.  Rows stay
keyed, so results are joined back by key, never zipped by position.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from corpusforge.session import map_arrow, small_batches


def map_with_model(df: DataFrame, load: Callable[[], object],
                   fn: Callable[[object, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """UDF1: run ``fn`` over Arrow batches with a model loaded once per task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for pdf in batches:
            yield fn(model, pdf)

    small_batches(df.sparkSession)
    return df.mapInPandas(run, schema)


def score_pairs(df: DataFrame, key_cols: list[str], load, fn, loss_col: str = "loss") -> DataFrame:
    """UDF1 as a pair scorer: ``fn(model, batch)`` returns one loss per row of ``batch``."""
    cols = df.columns
    schema = ", ".join(f"{c} {t}" for c, t in df.select(*key_cols).dtypes) + f", {loss_col} double"

    def score(model, pdf: pd.DataFrame) -> pd.DataFrame:
        out = pdf[key_cols].copy()
        out[loss_col] = pd.Series(fn(model, pdf[cols]), index=pdf.index).astype("float64")
        return out

    return map_with_model(df, load, score, schema)


@dataclass
class UserScorer:
    """UDF1 as the scorer of the selection loop: any model that gives each row a number of labels and a summed loss.

    ``train(train rows, validation rows)`` runs once per round on the driver and returns what the tasks need (small, such as the
    model's path; it is sent to each task); without it the model is fixed.  ``load(trained)`` runs once per task, and
    ``fn(model, batch)`` returns the labels and the summed losses of the rows of a pandas batch with ``columns``.
    A row whose number of labels is 0 or missing has a null loss and is never accepted.
    """
    load: Callable[[object], object]
    fn: Callable[[object, pd.DataFrame], tuple]
    columns: list[str]
    length: Column
    train: Callable[[DataFrame, DataFrame | None], object] | None = None
    key_cols: tuple[str, ...] = ("source", "pair_id")

    def fit(self, train: DataFrame, valid: DataFrame | None = None, batches: DataFrame | None = None):
        return None if self.train is None else self.train(train, valid)

    def score(self, model, df: DataFrame) -> DataFrame:
        given = df.sparkSession.sparkContext.broadcast(model)
        keys, columns, load, fn = list(self.key_cols), self.columns, self.load, self.fn
        rows = df.select(*keys, *[c for c in columns if c not in keys])
        schema = ", ".join(f"{c} {t}" for c, t in df.select(*keys).dtypes) + ", n_tok bigint, sum_nll double"

        def score(model, pdf: pd.DataFrame) -> pd.DataFrame:
            n, total = fn(model, pdf)
            out = pdf[keys].copy()
            out["n_tok"] = pd.Series(n, index=pdf.index).astype("Int64")
            out["sum_nll"] = pd.Series(total, index=pdf.index).astype("float64")
            return out

        scored = map_with_model(rows, lambda: load(given.value), score, schema)
        return scored.withColumn("loss", F.when(F.col("n_tok") > 0, F.round(F.col("sum_nll") / F.col("n_tok"), 6)))


@dataclass
class ForeignTokenizer:
    """UDF2: a tokenizer that is no Column expression (a library's, say).

    ``load()`` runs once per task, ``fn(model, texts)`` returns the tokens of each text of an Arrow batch.
    A null text has null tokens and is not given to ``fn``.
    """
    load: Callable[[], object]
    fn: Callable[[object, list[str]], list[list[str]]]

    def with_tokens(self, df: DataFrame, text_col: str, out_col: str = "tokens") -> DataFrame:
        names = [c for c in df.columns if c != out_col]
        rows, at = df.select(*names), names.index(text_col)
        load, fn = self.load, self.fn

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = load()
            for b in batches:
                texts = b.column(at).to_pylist()
                found = iter(fn(model, [t for t in texts if t is not None]))
                tokens = pa.array([None if t is None else next(found) for t in texts], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([*b.columns, tokens], [*b.schema.names, out_col])

        return map_arrow(rows, run, StructType([*rows.schema.fields, StructField(out_col, ArrayType(StringType()))]))


def add_tokens(df: DataFrame, text_col: str, tokenizer: Callable[[Column], Column] | ForeignTokenizer, out_col: str = "tokens") -> DataFrame:
    """UDF2: ``df`` with tokens by a Column -> Column function, which stays in the JVM, or by a foreign tokenizer."""
    if isinstance(tokenizer, ForeignTokenizer):
        return tokenizer.with_tokens(df, text_col, out_col)
    return df.withColumn(out_col, tokenizer(F.col(text_col)))
