"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusforge.session import scratch_path

# Python tasks work on slices of an Arrow batch that hold about this much text
# (or one row, if that row alone is larger).
SLICE_BYTES = 1 << 20
# Arrow batches between Spark and a Python worker.
BATCH_BYTES, BATCH_ROWS = 2 << 20, 1000
# Tables with more rows are joined by a shuffle.
BROADCAST_ROWS = 200_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def stored(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` below the shared checkpoint folder and read it back (cuts the lineage)."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_arrow(df: DataFrame, run, schema) -> DataFrame:
    """``mapInArrow`` with batches of about ``BATCH_BYTES``, as texts are long (the session keeps the setting)."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df.mapInArrow(run, schema)


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, which are counted; narrow rows are expected."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def without(docs: DataFrame, gone: DataFrame, match) -> DataFrame:
    """``docs`` without the rows that match a row of ``gone``; all columns are kept, whatever their names.

    ``match(column)`` is the condition, where ``column(name)`` is a column of ``docs`` and the columns of ``gone`` go by their names.
    """
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    marks = gone.select(*[F.col(c).alias(f"_gone_{c}") for c in gone.columns])
    kept = whole.join(broadcast_if_small(marks), match(lambda c: F.col(f"_row.`{c}`")), "left_anti")
    return kept.select("_row.*")


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column without nulls, and the offsets of its texts (one more than rows)."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


def slices(batches: Iterator[pa.RecordBatch], size_col: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the texts in column ``size_col`` of a slice hold at most ``limit`` bytes, or are one text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_buffer(batch.column(size_col))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
            yield batch.slice(at, end - at)
            at = end
