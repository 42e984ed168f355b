"""Length-bucketed batches and padding (WIN3, ARR3).

Rows of similar source length share a batch: rank by (length, key) and cut
every ``batch_size`` rows.  The rank comes from ``dense_index`` (range sort
plus per-partition offsets), not from an un-partitioned window; the batch
width is a window partitioned by batch, i.e. at most ``batch_size`` rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusforge.functions.text import pad_mask, pad_to
from corpusforge.operators.ordering import dense_index

BATCH_SIZE = 64


def length_batches(df: DataFrame, key_cols: list[str], length: Column,
                   batch_size: int = BATCH_SIZE) -> DataFrame:
    """Adds ``batch_len`` (sort length), ``batch_id`` and ``width`` (longest in batch)."""
    ranked = dense_index(df.withColumn("batch_len", length), ["batch_len", *key_cols], "_rank")
    b = ranked.withColumn("batch_id", F.floor(F.col("_rank") / batch_size)).drop("_rank")
    return b.withColumn("width", F.max("batch_len").over(Window.partitionBy("batch_id")))


def pad_batch(df: DataFrame, ids_col: str, pad_id, out_col: str = "padded",
              mask_col: str = "mask") -> DataFrame:
    """ARR3: pad ``ids_col`` to the batch width and add the padding mask."""
    w = F.max(F.size(ids_col)).over(Window.partitionBy("batch_id"))
    padded = df.withColumn(out_col, pad_to(F.col(ids_col), w, pad_id))
    return padded.withColumn(mask_col, pad_mask(F.col(out_col), pad_id))
