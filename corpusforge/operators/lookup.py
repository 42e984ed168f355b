"""Look-ups of whole arrays against a table, in place (JOI6, JOI7, JOI8, PIP7).

A look-up of every element of an array column by ``explode``, join and regrouping shuffles each element and
each row.  Where the table fits the byte limit for broadcasts, a task holds it as flat arrays (``Entries``) instead and maps the arrays of
an Arrow batch: distinct elements are looked up once per batch, and rows never leave their partition.  A larger table is joined by
``by_join``, where the row's elements are exploded, joined (AQE splits hot elements) and collected again in order.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from corpusforge.operators.joins import fits_arrays
from corpusforge.session import map_arrow, materialize


def _codes(values: pa.Array) -> np.ndarray:
    """A number for each value: whole numbers themselves, of others the crc32."""
    if pa.types.is_integer(values.type):
        return values.to_numpy(zero_copy_only=False).astype(np.int64)
    as_bytes = str.encode if pa.types.is_string(values.type) or pa.types.is_large_string(values.type) else lambda x: repr(x).encode()
    return np.fromiter((zlib.crc32(as_bytes(x)) for x in values.to_pylist()), np.int64, len(values)).astype(np.uint32)


class Entries:
    """Keys and values in flat arrays, ordered by the keys' codes: a tenth of what a dictionary of Python objects takes."""

    def __init__(self, keys: pa.Array, values: pa.Array):
        codes = _codes(keys)
        order = np.argsort(codes, kind="stable")
        self.codes, self.keys, self.values = codes[order], keys.take(pa.array(order)), values.take(pa.array(order))

    def find(self, wanted: pa.Array) -> np.ndarray:
        """The place of each wanted key (none is null), -1 if it is not there."""
        code = _codes(wanted)
        at = np.searchsorted(self.codes, code)
        place = np.full(len(code), -1, dtype=np.int64)
        left = np.arange(len(code))
        while True:
            left = left[at[left] < len(self.codes)]
            left = left[self.codes[at[left]] == code[left]]
            if not len(left):
                return place
            same = np.ones(len(left), dtype=bool)
            if not pa.types.is_integer(wanted.type):
                same = np.asarray(pc.equal(wanted.take(pa.array(left)), self.keys.take(pa.array(at[left]))))
            place[left[same]] = at[left[same]]
            left = left[~same]  # another key of the same code
            at[left] += 1


@dataclass
class SharedTable:
    """A table ``key -> value``: its entries in all tasks, or the table itself if it is too large for that."""

    table: DataFrame            # key, value
    shared: object | None       # broadcast of the entries

    @property
    def value_type(self):
        return self.table.schema["value"].dataType


def share(table: DataFrame, key: str, value: str) -> SharedTable:
    """Measure ``table`` in bytes and broadcast its entries if they fit; rows with a null key or value are left out.

    Of rows with the same key the one with the smallest value counts.
    """
    rows = materialize(table.select(F.col(key).alias("key"), F.col(value).alias("value")).filter("key IS NOT NULL AND value IS NOT NULL")
                       .groupBy("key").agg(F.min("value").alias("value")))
    if not fits_arrays(rows):
        return SharedTable(rows, None)
    got = rows.toArrow()
    keys, values = (pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type) for c in (got["key"], got["value"]))
    return SharedTable(rows, rows.sparkSession.sparkContext.broadcast(Entries(keys, values)))


def map_arrays(df: DataFrame, array_col: str, table: SharedTable, out_col: str, default=None, keep: bool = False,
               key_cols: list[str] | None = None, changed_col: str | None = None) -> DataFrame:
    """``df`` with ``out_col``: the value of each element of ``array_col``, in order.

    An element that the table does not have gives ``default``, or itself with ``keep``, and then null elements vanish.  A null array
    gives an empty one.  With ``changed_col`` (and ``keep``) that column has the number of elements that differ from theirs.  ``key_cols`` (default: all other columns that can be grouped) identify rows where the join path is taken.
    """
    if table.shared is None:
        out = by_join(df, array_col, table, out_col, default, keep, key_cols)
        if changed_col is None:
            return out
        there = F.coalesce(F.filter(F.col(array_col), lambda x: x.isNotNull()), F.array().cast(df.schema[array_col].dataType))
        return out.withColumn(changed_col, F.size(F.filter(F.zip_with(there, F.col(out_col), lambda a, b: a != b), lambda x: x)).cast("long"))
    shared = table.shared
    names = [c for c in df.columns if c != out_col]
    rows = df.select(*names)
    at = names.index(array_col)
    from pyspark.sql.pandas.types import to_arrow_type

    out_type = to_arrow_type(table.value_type)
    schema = StructType([*rows.schema.fields, StructField(out_col, ArrayType(table.value_type)),
                         *([StructField(changed_col, LongType())] if changed_col else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = shared.value
        for b in batches:
            column = b.column(at)
            size = np.array([x or 0 for x in pc.list_value_length(column).to_pylist()], dtype=np.int64)
            flat = column.flatten()
            coded = flat.dictionary_encode()
            distinct = coded.dictionary
            place = entries.find(distinct)
            found = entries.values.take(pa.array(place, mask=place < 0)).cast(out_type)
            if keep:
                found = pc.coalesce(found, distinct.cast(out_type))
            elif default is not None:
                found = found.fill_null(pa.scalar(default, out_type))
            found = pa.concat_arrays([found, pa.array([None if keep else default], out_type)])
            index = coded.indices.fill_null(len(distinct))
            changes = []
            if changed_col:
                other = np.append(np.asarray(pc.not_equal(found[:-1], distinct.cast(out_type))), False)[index.to_numpy()]
                changes = [pa.array(np.bincount(np.repeat(np.arange(len(size)), size)[other], minlength=len(size)), pa.int64())]
            out = found.take(index)
            if keep and flat.null_count:
                there = np.asarray(flat.is_valid())
                row = np.repeat(np.arange(len(size)), size)
                size = np.bincount(row[there], minlength=len(size))
                out = out.filter(pa.array(there))
            offsets = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(offsets, out), *changes], schema.names)

    return map_arrow(rows, run, schema)


def by_join(df: DataFrame, array_col: str, table: SharedTable, out_col: str, default=None, keep: bool = False,
            key_cols: list[str] | None = None) -> DataFrame:
    """``map_arrays`` for tables of any size."""
    keys = key_cols or [c for c in df.columns if c not in (array_col, out_col)]
    rest = [c for c in df.columns if c not in (*keys, out_col)]
    ex = df.select(*keys, F.posexplode_outer(F.col(array_col)).alias("_p", "_e"))
    joined = ex.join(table.table.select(F.col("key").alias("_e"), F.col("value").alias("_v")), "_e", "left")
    value = F.coalesce("_v", "_e") if keep else F.coalesce("_v", F.lit(default).cast(table.value_type)) if default is not None else F.col("_v")
    there = F.col("_e").isNotNull() if keep else F.col("_p").isNotNull()
    item = F.when(there, F.struct("_p", value.alias("_w")))
    got = joined.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("_s")).select(*keys, F.col("_s._w").alias(out_col))
    cond = None
    other = got.select(*[F.col(k).alias(f"_k_{k}") for k in keys], out_col)
    for k in keys:
        same = df[k].eqNullSafe(F.col(f"_k_{k}"))
        cond = same if cond is None else cond & same
    return df.select(*keys, *rest).join(other, cond, "left").select(*keys, *rest, out_col)
