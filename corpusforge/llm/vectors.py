"""Embedding columns as integer vectors, and sums over all rows of a table by cell."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusforge.llm.common import in_arrow


def integer_rows(column: pa.Array, scale: int, limit: int, dims: int, exact_dims: bool) -> tuple[np.ndarray, np.ndarray]:
    """``floor(scale * x)`` of the vectors of a list column, and which rows have a usable vector.

    Usable: not null, no null or non-finite component, and ``dims`` components (without ``exact_dims`` at
    most that many, the missing ones being 0).  Components beyond ``limit`` in size become the limit.
    """
    n = len(column)
    out = np.zeros((n, dims), dtype=np.int64)
    size = np.array([-1 if x is None else x for x in pc.list_value_length(column).to_pylist()], dtype=np.int64)
    flat = column.flatten()  # values of the rows that are not null
    values = pc.cast(flat, pa.float64()).to_numpy(zero_copy_only=False) if len(flat) else np.zeros(0)
    missing = np.isnan(values) | np.isinf(values)  # a null component comes as not-a-number
    row = np.repeat(np.arange(n), np.maximum(size, 0))
    usable = (size == dims) if exact_dims else (size >= 0) & (size <= dims)
    usable[row[missing]] = False
    place = np.arange(len(values)) - np.repeat(np.cumsum(np.maximum(size, 0)) - np.maximum(size, 0), np.maximum(size, 0))
    take = usable[row]
    out[row[take], place[take]] = np.clip(np.floor(values[take] * scale), -limit, limit).astype(np.int64)
    return out, usable


def cell_sums(df: DataFrame, sums: Callable[[pa.RecordBatch], np.ndarray], kind: str = "double") -> dict[int, float | int]:
    """Sums over all rows of what ``sums`` gives for a batch, one number for each cell.

    Every task adds up its own batches and hands on one row for each cell, so that as
    many rows as there are cells reach the driver, whatever the table's size.
    """
    arrow = pa.float64() if kind == "double" else pa.int64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                part = sums(b)
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total, arrow)], ["cell", "value"])

    rows = in_arrow(df, run, f"cell bigint, value {kind}").groupBy("cell").agg(F.sum("value").alias("value")).collect()
    return {r["cell"]: r["value"] for r in rows}
