"""Order statistics, exact quantiles and dense indexes without one-task windows.

``row_number() OVER (ORDER BY x)`` and a global ``percentile`` both funnel the
whole table through a single task.  The helpers here keep the work spread:

* ``order_statistics`` finds the k-th smallest rows of a range-partitioned sort
  by the rows per partition; only the rows asked for reach the driver.
* ``exact_quantile`` is linear interpolation between two order statistics,
  the definition used by pandas, Spark ``percentile`` and ``quantile_cont``.
* ``dense_index`` assigns 0..n-1 in a total order through a range-partitioned
  sort plus per-partition offsets (the ``zipWithIndex`` idea, DataFrame form).
* ``first_n`` keeps the first n rows in an order as a filter on a cut-off.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusforge.session import materialize


def order_statistics(df: DataFrame, cols: list[str], ranks: list[int]) -> list[tuple | None]:
    """Values ``cols`` of the rows with the given ranks (1-based) in the order of ``cols``.

    One path for any size and type: the keys are range-sorted and materialised,
    the rows per partition are counted, and each rank is looked up at its place in its
    partition.  Rows with a null in the first column are ignored; a rank outside gives ``None``.
    """
    base = df.select(*cols).filter(F.col(cols[0]).isNotNull())
    tagged, counts = _numbered(base.orderBy(*cols))
    places: dict[int, int] = {}
    for k in set(ranks):
        before = 0
        for part, n in counts:
            if 0 < k - before <= n:
                places[k] = (part << 33) + k - before - 1
                break
            before += n
    found = {}
    if places:
        rows = tagged.filter(F.col("_mid").isin(list(places.values()))).collect()  # one per rank
        found = {r["_mid"]: tuple(r[c] for c in cols) for r in rows}
    return [found.get(places.get(k)) for k in ranks]


def order_statistic(df: DataFrame, col: str, k: int, tie_cols: list[str] | None = None) -> tuple | None:
    """The row values ``(col, *tie_cols)`` of the k-th smallest row (1-based), or ``None``."""
    return order_statistics(df, [col, *(tie_cols or [])], [k])[0]


def _numbered(ordered: DataFrame) -> tuple[DataFrame, list[tuple[int, int]]]:
    """A sorted frame, materialised so that all passes see the same partitions, with ``_mid`` (the place
    in the partition, plus the partition number times 2**33), and the rows of each partition."""
    tagged = materialize(ordered).withColumn("_pid", F.spark_partition_id()) \
                                 .withColumn("_mid", F.monotonically_increasing_id())
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n")).collect()
    return tagged, sorted((r["_pid"], r["_n"]) for r in counts)


def exact_quantile(df: DataFrame, col: str, q: float, n: int | None = None):
    """Exact quantile with linear interpolation between order statistics (AGG4).

    ``n`` (the number of non-null values) may be passed when already known.
    """
    base = df.filter(F.col(col).isNotNull() & ~F.isnan(F.col(col).cast("double")))
    n = base.count() if n is None else n
    if n == 0:
        return None
    pos = q * (n - 1)
    lo_rank, hi_rank = math.floor(pos), math.ceil(pos)
    v_lo, v_hi = (float(v[0]) for v in order_statistics(base, [col], [lo_rank + 1, hi_rank + 1]))
    return v_lo + (pos - lo_rank) * (v_hi - v_lo)


def first_n(df: DataFrame, n: int, order_col: str, tie_cols: list[str] | None = None) -> DataFrame:
    """Keep the first ``n`` rows in (order_col, tie_cols) order, as a filter."""
    tie_cols = list(tie_cols or [])
    cut = order_statistic(df, order_col, n, tie_cols)
    if cut is None:
        return df
    return df.filter(_le_tuple([order_col] + tie_cols, cut))


def _le_tuple(cols: list[str], values) -> Column:
    """Lexicographic ``(cols) <= (values)``."""
    cond = F.col(cols[-1]) <= F.lit(values[-1])
    for c, v in zip(reversed(cols[:-1]), reversed(values[:-1])):
        cond = (F.col(c) < F.lit(v)) | ((F.col(c) == F.lit(v)) & cond)
    return cond


def dense_index(df: DataFrame, order: list[Column | str], index_col: str = "idx",
                start: int = 0) -> DataFrame:
    """Consecutive index ``start..start+n-1`` in a total order.

    The sorted frame is checkpointed so that the counting pass and the
    numbering pass see the same partitions; the offset table has one row per
    partition and is broadcast.
    """
    spark = df.sparkSession
    tagged, counts = _numbered(df.orderBy(*order))
    offsets, acc = [], start
    for part, n in counts:
        offsets.append((part, acc))
        acc += n
    off = spark.createDataFrame(offsets or [(0, start)], "_pid int, _off long")
    return (tagged.join(F.broadcast(off), "_pid")
            .withColumn(index_col, F.col("_off") + F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33))
            .drop("_pid", "_mid", "_off"))
