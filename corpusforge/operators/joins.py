"""Join helpers.

``join_small`` broadcasts the right side only after measuring its size in bytes
(one partial aggregation over the materialised side); beyond the limit it leaves
the join to the sort-merge path, where AQE splits skewed partitions of the
big side (``spark.sql.adaptive.skewJoin.enabled``).  Frequent tokens are the
typical hot keys here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, StringType

from corpusforge.session import materialize

# Bytes of data above which a side is never broadcast; a session can lower or raise it
# with ``corpusforge.broadcast.maxBytes``.
BROADCAST_BYTES = 32 << 20
# Fixed value: what a row takes besides its strings.
_ROW_BYTES = 16


def broadcast_limit(df: DataFrame) -> int:
    v = df.sparkSession.conf.get("corpusforge.broadcast.maxBytes", None)
    return int(v) if v is not None else BROADCAST_BYTES


def _bytes_of(col: Column, kind: DataType) -> Column:
    if isinstance(kind, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(col), F.lit(0)) + 8
    if isinstance(kind, ArrayType):
        inner = F.octet_length(F.array_join(col, "")) if isinstance(kind.elementType, StringType) else F.lit(0)
        return F.coalesce(inner, F.lit(0)) + 16 * F.greatest(F.size(col), F.lit(0)) + 8
    return F.lit(8)


def row_bytes(df: DataFrame) -> Column:
    """About how many bytes the rows take, as an aggregate."""
    per_row = F.lit(_ROW_BYTES)
    for f in df.schema.fields:
        per_row = per_row + _bytes_of(F.col(f"`{f.name}`"), f.dataType)
    return F.sum(per_row.cast("long"))


def data_bytes(df: DataFrame) -> int:
    """About how many bytes the rows take: one partial aggregate, one row to the driver."""
    return int(df.agg(row_bytes(df).alias("b")).first()["b"] or 0)


def fits_broadcast(df: DataFrame, max_bytes: int | None = None) -> bool:
    """True when the data of ``df`` (best a materialised table, it is scanned) is within the limit."""
    return data_bytes(df) <= (broadcast_limit(df) if max_bytes is None else max_bytes)


def fits_arrays(df: DataFrame) -> bool:
    """True when the columns of ``df`` (materialised; strings and numbers) are within the limit as flat arrays: their bytes and an offset or number each."""
    per_row = F.lit(0)
    for f in df.schema.fields:
        text = isinstance(f.dataType, (StringType, BinaryType))
        per_row = per_row + (F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0)) + 4 if text else F.lit(8))
    return int(df.agg(F.sum(per_row.cast("long")).alias("b")).first()["b"] or 0) <= broadcast_limit(df)


def join_small(big: DataFrame, small: DataFrame, on, how: str = "inner",
               max_bytes: int | None = None) -> DataFrame:
    small = materialize(small)
    if fits_broadcast(small, max_bytes):
        return big.join(F.broadcast(small), on, how)
    return big.join(small, on, how)
